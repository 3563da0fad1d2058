import datetime
import itertools
import math

import numpy as np
import pytest

from harborlight.operators import changepoint, ranges, signals
from harborlight.plans import queries
from pyspark.sql import functions as F


def _expanded(spark):
    rows = [("f", "g1", "equifax", "c1"), ("f", "g1", "experian", "c1"), ("f", "g1", "transunion", "c1"), ("f", "g2", "equifax", "c2"), ("f", "g3", "experian", "c2")]
    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame([(f, g, c, k, "f", day) for f, g, c, k in rows], "family string, group_id string, company_id string, cluster_id string, cluster_family string, period_month date")


def test_cells_partition_the_units(spark):
    cells = signals.contingency(_expanded(spark)).collect()
    assert all(r.a + r.b + r.c + r.d == 5 for r in cells)
    one = next(r for r in cells if (r.company_id, r.cluster_id) == ("equifax", "c1"))
    assert (one.a, one.b, one.c, one.d) == (1, 1, 2, 1)


def test_prr_ror_and_bh(spark):
    df = spark.createDataFrame([("f", "x", "k", 10, 20, 30, 400), ("f", "y", "k", 5, 50, 60, 700), ("f", "z", "k", 0, 5, 3, 2)], "family string, company_id string, cluster_id string, a long, b long, c long, d long")
    got = {r.company_id: r for r in signals.ror(signals.prr(df)).collect()}
    assert got["x"].prr == pytest.approx((10 / 30) / (30 / 430))
    z = abs(math.log((10 / 20) / (30 / 400))) / math.sqrt(1 / 10 + 1 / 20 + 1 / 30 + 1 / 400)
    assert got["x"].p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-12)
    assert got["z"].prr is None and got["z"].p == 1.0
    p = [0.001, 0.02, 0.03, 0.04, 0.5]
    t = spark.createDataFrame([("f", str(i), "k", x) for i, x in enumerate(p)], "family string, company_id string, cluster_id string, p double")
    q = [r.q for r in signals.bh(t).orderBy("p").collect()]
    assert q == pytest.approx([0.005, 0.05, 0.05, 0.05, 0.5])


def test_gamma_quantile_inverts():
    shape = np.array([0.5, 1.0, 3.7, 40.0, 900.0])
    x = signals.gamma_quantile(0.05, shape)
    assert signals._lower_gamma(shape, x) == pytest.approx(np.full(5, 0.05), abs=1e-9)
    assert x[1] == pytest.approx(-math.log(0.95), abs=1e-9)


def test_prior_degenerates_to_one(spark):
    df = spark.createDataFrame([("f", 5, 5.0), ("f", 7, 7.0)], "family string, a long, expected double")
    r = signals.gamma_prior(df).first()
    assert (r.alpha, r.beta) == (1.0, 1.0)


def test_panel_counts_groups_once(spark):
    got = {(r.cluster_id, r.company_id): (r.n, r.denom) for r in signals.panel(_expanded(spark)).collect()}
    assert got["c1", signals.ALL] == (1, 3) and got["c2", "experian"] == (1, 2)


def _ewma_by_definition(v, lam=0.2, width=3.0, base=12):
    e = v[0]
    for t in range(1, len(v)):
        e = lam * v[t] + (1 - lam) * e
        if t >= base and len(v) > base + 1:
            mu, sd = np.mean(v[t - base : t]), np.std(v[t - base : t], ddof=1)
            if sd > 1e-12 and e - mu > width * sd * math.sqrt(lam / (2 - lam)):
                return t, (e - mu) / sd
    return None


def _segments_by_definition(x, penalty, min_size, grid):
    """The cheapest of all segmentations on the grid."""
    n = len(x)
    d = (x[:, None] - x[None, :]) ** 2
    med = np.median(d[np.triu_indices(n, 1)])
    k = np.exp(-np.clip(d / (med or 1.0), 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    cost = lambda i, j: np.trace(k[i:j, i:j]) - k[i:j, i:j].sum() / (j - i)
    inner = [b for b in range(0, n, grid) if b >= min_size]
    best = None
    for r in range(len(inner) + 1):
        for cut in itertools.combinations(inner, r):
            ends = [0, *cut, n]
            if all(b - a >= min_size for a, b in itertools.pairwise(ends)):
                total = sum(cost(a, b) + penalty for a, b in itertools.pairwise(ends))
                if best is None or total < best[0] - 1e-9:
                    best = total, ends[1:]
    return best[1]


def test_ewma_and_pelt():
    rng = np.random.default_rng(1)
    flat, step = rng.poisson(10, 60).astype(float), np.r_[rng.poisson(5, 30), rng.poisson(40, 30)].astype(float)
    rows = np.stack([flat, step, np.full(60, 3.0), rng.random(60), np.r_[step[:45], np.zeros(15)]])
    for got, v in zip(changepoint.ewma_alarms(rows), rows):
        want = _ewma_by_definition(v)
        assert got == want or (got[0] == want[0] and got[1] == pytest.approx(want[1]))
    assert changepoint.ewma_alarms(rows)[1][0] == changepoint.ewma_alarms(rows)[4][0]  # later data moves no alarm
    assert changepoint.ewma_alarms(rows[:, :13]) == [None] * 5 and changepoint.pelt_alarms(rows[:, :8]) == [None] * 5
    assert changepoint.pelt_alarms(rows)[1][0] == 30 and changepoint.pelt_alarms(rows[:, ::-1])[1] is None and changepoint.pelt_alarms(rows)[2] is None
    for seed in range(6):
        x = np.random.default_rng(seed).random((3, 31)) + np.repeat([0, seed, 0], [10, 10, 11]) * 0.3
        assert changepoint.segment_ends(x, 1.0) == [_segments_by_definition(v, 1.0, 6, 5) for v in x]


def test_densify_zeros_and_empty(spark):
    s = spark.createDataFrame([("k", "x", datetime.date(2020, 2, 1), 4, 0.5), ("k", "x", datetime.date(2021, 2, 1), 9, 0.9)], "cluster_id string, company_id string, period_month date, n long, share double")
    assert [(r.n, r.share) for r in signals.densify(s, "2020-01-01", "2020-03-01").orderBy("period_month").collect()] == [(0, 0.0), (4, 0.5), (0, 0.0)]
    assert signals.densify(s.limit(0), "2020-01-01", "2020-03-01").count() == 0 and signals.month_axis(s.limit(0)) is None
    assert signals.month_axis(s) == ("2020-02-01", "2021-02-01") and signals.series_arrays(s, "2020-01-01", "2020-03-01").first().n_total == 4
    assert signals.contingency(_expanded(spark).limit(0)).count() == 0


def test_erfc_is_exact_in_the_tail(spark):
    x = [0.0, 1e-9, 0.1, 0.46875, 0.5, 1.0, 3.9, 4.0, 4.1, 8.0, 20.0]
    got = [r.e for r in spark.createDataFrame([(v,) for v in x], "x double").select(signals.erfc(F.col("x")).alias("e")).collect()]
    assert got == pytest.approx([math.erfc(v) for v in x], rel=1e-13)


def test_bh_by_ranges_is_the_definition(spark):
    rng = np.random.default_rng(7)
    rows = [("big" if i % 10 else "small", str(i), "k", float(round(p, 2) ** 2)) for i, p in enumerate(rng.random(900))] + [(None, "n1", "k", 0.2), (None, "n2", "k", 0.01)]
    t = spark.createDataFrame(rows, "family string, company_id string, cluster_id string, p double").repartition(7)
    got = {(r.family, r.company_id): r.q for r in signals.bh(t).collect()}
    for family in ("big", "small", None):
        mine = sorted([(p, c) for f, c, _, p in rows if f == family])
        low = 1.0
        for k in range(len(mine), 0, -1):
            low = min(low, mine[k - 1][0] * len(mine) / k)
            assert got[family, mine[k - 1][1]] == pytest.approx(low)
    assert signals.bh(t.limit(0)).count() == 0


def test_ranks_by_ranges(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as f", "id * 7919 % 101 as v", "1 as rank_before")
    got = ranges.ranked(df, ["f"], [F.desc("v"), "id"], "r").collect()
    by = {}
    for r in sorted(got, key=lambda r: (-r.v, r.id)):
        by[r.f] = by.get(r.f, 0) + 1
        assert r.r == by[r.f]
    assert sorted(r.r for r in ranges.ranked(df, [], ["id"], "r").collect()) == list(range(1, 501)) and ranges.ranked(df.limit(0), ["f"], ["id"]).count() == 0


def test_signal_rows_scopes_and_control(spark):
    day = datetime.date(2020, 5, 1)
    scored = spark.createDataFrame([("k", "a", 2.5, 1.0, 4.0, 0.001, 0.01), ("k", "b", 9.0, 1.0, 4.0, 0.2, 0.3), ("thin", "a", 9.0, 1.0, 4.0, 0.0, 0.0), ("loose", "a", 9.0, 1.0, 4.0, 0.0, 0.0)], "cluster_id string, company_id string, eb05 double, prr_low double, prr_high double, p double, q double")
    changes = spark.createDataFrame([("k", signals.ALL, "ewma", day, 3.0), ("k", signals.ALL, "pelt", datetime.date(2020, 3, 1), 1.5), ("k", "none", "ewma", day, 1.0)], "cluster_id string, company_id string, method string, period_month date, statistic double")
    sup = spark.createDataFrame([("k", "a", 20, 30), ("k", "b", 20, 30), ("thin", "a", 14, 99), ("loose", "a", 50, 50), ("k", signals.ALL, 60, 90)], "cluster_id string, company_id string, groups long, complaints long")
    rows = signals.signal_rows(scored, changes, sup, "2020-06-01", "2020-06-20")
    assert rows.count() == 7 and {r.n_supporting_groups for r in rows.where("company_id = 'none'").collect()} == {0}
    clusters = spark.createDataFrame([("k", 0.8), ("thin", 0.8), ("loose", 0.44)], "cluster_id string, coherence double")
    got = signals.in_order(signals.alert_scopes(rows, clusters)).collect()
    assert [(r.cluster_id, r.company_id, r.eb05, r.changed, str(r.change_month)) for r in got] == [("k", "a", 2.5, 0, "None"), ("k", signals.ALL, None, 1, "2020-03-01")]
    tracks = {r.track: r.n_scopes for r in signals.alert_tracks(signals.alert_scopes(rows, clusters), spark.createDataFrame([("k", True)], "cluster_id string, is_novel boolean")).collect()}
    assert tracks == {"all": 2, "novel": 2}
    r = signals.false_alert_rate(scored, sup).first()
    assert (r.tests, r.alerts, r.passes) == (4, 2, False)
    assert signals.alert_scopes(rows.limit(0), clusters).count() == 0


def test_companies_have_alarms(spark, tmp_path):
    months = [datetime.date(1995 + i // 12, i % 12 + 1, 3) for i in range(40)]
    # of 25 groups a month, company 7 has more and more of part 1; company 8 has too few groups; company 9 has less by as much, so the total stays level
    each = [(c, p, m) for i, m in enumerate(months) for c, k in ((7, 2 + i % 2 + 18 * (i >= 24)), (9, 22 - i % 2 - 18 * (i >= 24))) for p in [1] * k + [2] * (25 - k)] + [(8, 1, months[30])]
    spark.createDataFrame([(i, c, p, 1, m) for i, (c, p, m) in enumerate(each)], "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, "1-URGENT") for i in range(len(each))], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "TIN"), (2, "BRASS")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.cluster_id[9:], r.company_id, r.method): r.period_month for r in queries.change_alarms(spark, str(tmp_path)).collect()}
    assert got["TIN", "7", "ewma"] == datetime.date(1997, 1, 1) and got["BRASS", "9", "ewma"] == datetime.date(1997, 1, 1)
    assert not {("TIN", "8"), ("TIN", signals.ALL)} & {k[:2] for k in got}

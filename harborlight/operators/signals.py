"""Population, panel, contingency, disproportionality and alert operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators import ranges
from harborlight.session import cut

ALL = "__ALL__"
MIN_A, ALPHA, MIN_GROUPS, MIN_COHERENCE = 5, 0.05, 15, 0.45
PRIOR_LOW, PRIOR_HIGH = 0.05, 100.0


def representatives(units: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each group in the given order, as (group_id, cluster_id, cluster_family)."""
    first = F.min_by(F.struct("cluster", "family"), F.struct(*order))
    return units.groupBy("group_id").agg(first.alias("f")).select("group_id", F.col("f.cluster").alias("cluster_id"), F.col("f.family").alias("cluster_family"))


def expand(units: DataFrame, order: list[str], excluded: DataFrame | None = None, before: str | None = None) -> DataFrame:
    """One row for each unit with its group's representative's cluster; excluded groups and units on or after `before` leave first."""
    if before is not None:
        units = units.where(F.col("day") < F.lit(before).cast("date"))
    if excluded is not None:
        units = units.join(excluded.select("group_id").distinct(), "group_id", "left_anti")
    return units.join(representatives(units, order), "group_id")


def panel(expanded: DataFrame, min_groups: int = 1) -> DataFrame:
    """(cluster_id, company_id, period_month, n, denom, share): distinct groups, for each company and for all."""
    own = expanded.where("family = cluster_family and cluster_id is not null")
    all_denom = expanded.groupBy("family", "period_month").agg(F.count_distinct("group_id").alias("denom"))
    co_denom = expanded.where("company_id is not null").groupBy("family", "company_id", "period_month").agg(F.count_distinct("group_id").alias("denom"))
    total = own.groupBy("cluster_id", "family", "period_month").agg(F.count_distinct("group_id").alias("n")).join(all_denom, ["family", "period_month"])
    each = own.where("company_id is not null").groupBy("cluster_id", "family", "company_id", "period_month").agg(F.count_distinct("group_id").alias("n"))
    each = each.where(F.col("n") >= min_groups).join(co_denom, ["family", "company_id", "period_month"])
    cols = ["cluster_id", "company_id", "period_month", "n", "denom"]
    both = total.withColumn("company_id", F.lit(ALL)).select(*cols).unionByName(each.select(*cols))
    return both.withColumn("share", F.col("n") / F.col("denom"))


def contingency(expanded: DataFrame) -> DataFrame:
    """(family, company_id, cluster_id, a, b, c, d) over distinct (family, group, company) units; a + b + c + d is the family's units."""
    cluster = F.when(F.col("family") == F.col("cluster_family"), F.col("cluster_id"))
    units = expanded.where("company_id is not null").select("family", "group_id", "company_id", cluster.alias("cluster_id")).distinct()
    cell = cut(units.groupBy("family", "company_id", "cluster_id").agg(F.count(F.lit(1)).alias("n")))  # all margins come from it
    by_company = cell.groupBy("family", "company_id").agg(F.sum("n").alias("nc"))
    by_cluster = cell.where("cluster_id is not null").groupBy("family", "cluster_id").agg(F.sum("n").alias("nk"))
    by_family = cell.groupBy("family").agg(F.sum("n").alias("nf"))
    j = cell.where("cluster_id is not null").join(by_company, ["family", "company_id"]).join(by_cluster, ["family", "cluster_id"]).join(by_family, "family")
    return j.select("family", "company_id", "cluster_id", F.col("n").alias("a"), (F.col("nc") - F.col("n")).alias("b"), (F.col("nk") - F.col("n")).alias("c"), (F.col("nf") - F.col("nc") - F.col("nk") + F.col("n")).alias("d"))


# A rational approximation of the complementary error function in three ranges, with a relative error below 1e-15.
_ERF_A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_ERF_B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_ERF_C = (
    5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8,
)
_ERF_D = (
    1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
)
_ERF_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_ERF_Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(t: Column, top: tuple[float, ...], bottom: tuple[float, ...]) -> Column:
    """(top[-1] t^n + top[0] t^(n-1) + ... ) / (t^n + bottom[0] t^(n-1) + ...), by Horner's rule."""
    num, den = F.lit(top[-1]) * t, t
    for i in range(len(bottom) - 1):
        num, den = (num + top[i]) * t, (den + bottom[i]) * t
    return (num + top[len(bottom) - 1]) / (den + bottom[-1])


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, exact to the last digits also where it is tiny."""
    small = 1 - x * _ratio(x * x, _ERF_A, _ERF_B)
    mid = F.exp(-x * x) * _ratio(x, _ERF_C, _ERF_D)
    y = 1 / (x * x)
    large = F.exp(-x * x) / x * (1 / math.sqrt(math.pi) - y * _ratio(y, _ERF_P, _ERF_Q))
    return F.when(x <= 0.46875, small).when(x <= 4, mid).otherwise(large)


def prr(cells: DataFrame) -> DataFrame:
    """cells plus prr, prr_low, prr_high; null where a or c is not positive."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    ratio = (a / (a + b)) / (c / (c + d))
    se = F.sqrt(F.greatest(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d), F.lit(1e-12)))
    ok = (F.col("a") > 0) & (F.col("c") > 0)
    return cells.withColumn("prr", F.when(ok, ratio)).withColumn("prr_low", F.when(ok, ratio * F.exp(-1.96 * se))).withColumn("prr_high", F.when(ok, ratio * F.exp(1.96 * se)))


def ror(cells: DataFrame) -> DataFrame:
    """cells plus ror, z and two-sided p; a cell that isn't positive gives (null, null, 1)."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    ok = (F.least("a", "b", "c", "d")) > 0
    ratio = (a / b) / (c / d)
    z = F.abs(F.log(ratio)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return cells.withColumn("ror", F.when(ok, ratio)).withColumn("z", F.when(ok, z)).withColumn("p", F.when(ok, erfc(F.col("z") / math.sqrt(2))).otherwise(1.0))


def testable(cells: DataFrame, min_a: int = MIN_A) -> DataFrame:
    return cells.where((F.col("a") >= min_a) & (F.least("b", "c", "d") > 0))


def bh(tests: DataFrame, p: str = "p", family: str = "family", ties: tuple[str, ...] = ("company_id", "cluster_id")) -> DataFrame:
    """tests plus q: Benjamini-Hochberg step-up within a family, of any size: ranks come from ranges, and minima of later ranges are carried over."""
    r = cut(ranges.ranked(cut(tests), [family], [p, *ties], "__r"))  # ranges are drawn from the tests before they are filled
    n = r.groupBy(F.col(family).alias("__f")).agg(F.count(F.lit(1)).alias("__n"))
    raw = r.join(n, F.col(family).eqNullSafe(F.col("__f"))).withColumn("__raw", F.col(p) * F.col("__n") / F.col("__r")).drop("__f", "__n")
    lows = raw.groupBy(F.col(family).alias("__f"), F.col("__range").alias("__g")).agg(F.min("__raw").alias("__low"))
    after = Window.partitionBy("__f").orderBy(F.desc("__g")).rowsBetween(Window.unboundedPreceding, -1)
    later = lows.select("__f", "__g", F.min("__low").over(after).alias("__later"))
    down = Window.partitionBy(family, "__range").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = raw.join(later, F.col(family).eqNullSafe(F.col("__f")) & (F.col("__range") == F.col("__g")))
    q = F.least(F.min("__raw").over(down), F.col("__later"), F.lit(1.0))
    return j.withColumn("q", F.greatest(F.lit(0.0), q)).select(*(c for c in tests.columns if c != "q"), "q")


def with_expected(cells: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    return cells.withColumn("expected", (a + b) * (a + c) / (a + b + c + d))


def gamma_prior(cells: DataFrame) -> DataFrame:
    """(family, alpha, beta) by the method of moments over a / expected; a degenerate family gets (1, 1)."""
    r = cells.withColumn("__r", F.col("a") / F.col("expected")).groupBy("family").agg(F.avg("__r").alias("m"), F.var_pop("__r").alias("v"))
    flat = (F.col("v") <= 1e-12) | (F.col("m") <= 1e-12)
    clip = lambda x: F.greatest(F.lit(PRIOR_LOW), F.least(F.lit(PRIOR_HIGH), x))
    beta = F.col("m") / F.when(flat, 1.0).otherwise(F.col("v"))
    return r.select("family", F.when(flat, 1.0).otherwise(clip(beta * F.col("m"))).alias("alpha"), F.when(flat, 1.0).otherwise(clip(beta)).alias("beta"))


def shrink(cells: DataFrame, prior: DataFrame) -> DataFrame:
    """cells plus alpha, beta and ebgm, the posterior mean."""
    return cells.join(prior, "family").withColumn("ebgm", (F.col("alpha") + F.col("a")) / (F.col("beta") + F.col("expected")))


def _lower_gamma(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, by series and continued fraction."""
    out = np.zeros_like(x)
    lead = np.exp(np.clip(s * np.log(np.maximum(x, 1e-300)) - x - np.array([math.lgamma(v) for v in s]), -700, 700))
    low = x < s + 1
    term = total = 1 / s
    for k in range(1, 400):
        term = np.where(low, term * x / (s + k), 0)
        total = total + term
        if not (term > 1e-17 * total).any():
            break
    out = np.where(low, lead * total, out)
    b = x + 1 - s
    c = np.full_like(x, 1e300)
    d = 1 / np.where(b == 0, 1e-300, b)
    h = d
    for k in range(1, 400):
        an = -k * (k - s)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = np.where(low, h, h * d * c)
        if not (np.abs(d * c - 1) > 1e-15)[~low].any():
            break
    return np.where(low, out, 1 - lead * h)


def gamma_quantile(p: float, shape: np.ndarray) -> np.ndarray:
    """Quantile of Gamma(shape, rate 1) by bisection from a Wilson-Hilferty bracket."""
    hi = shape + 10 * np.sqrt(shape) + 10
    lo = np.zeros_like(hi)
    for _ in range(90):
        mid = (lo + hi) / 2
        below = _lower_gamma(shape, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def eb05(shrunk: DataFrame) -> DataFrame:
    """shrunk plus eb05, the 5th percentile of the posterior."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s = (pdf["alpha"] + pdf["a"]).to_numpy(float)
            yield pdf.assign(eb05=gamma_quantile(0.05, s) / (pdf["beta"] + pdf["expected"]).to_numpy(float) if len(pdf) else pd.Series(dtype=float))

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shrunk.schema)
    return shrunk.mapInPandas(run, f"{cols}, eb05 double")


def support(expanded: DataFrame) -> DataFrame:
    """(cluster_id, company_id, groups, complaints) by (cluster, company) and by cluster as the total; rows without a company count in the total only.

    Distinct groups first by (cluster, company, group), then both grouping sets from those, so nothing is counted that isn't wanted.
    """
    own = expanded.where("cluster_id is not null")
    by = own.groupBy("cluster_id", "company_id", "group_id").agg(F.count(F.lit(1)).alias("m"))
    each = by.where("company_id is not null").groupBy("cluster_id", "company_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("m").alias("complaints"))
    total = by.groupBy("cluster_id", "group_id").agg(F.sum("m").alias("m")).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("m").alias("complaints"))
    return each.unionByName(total.withColumn("company_id", F.lit(ALL)).select(*each.columns))


def month_axis(rows: DataFrame, month: str = "period_month") -> tuple[str, str] | None:
    """(first, last) month in scope as ISO dates; None for no rows. One aggregate."""
    r = rows.agg(F.min(month), F.max(month)).first()
    return (str(r[0]), str(r[1])) if r[0] is not None else None


def series_arrays(series: DataFrame, lo: str, hi: str) -> DataFrame:
    """(cluster_id, company_id, n_total, n, share): one row a series, n and share arrays over the months from lo to hi, absent months 0.

    Months outside lo to hi are left out of the arrays and of n_total. A month given twice is an error of the map, as it should be.
    """
    months = F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"), F.expr("interval 1 month"))
    inside = series.where(F.col("period_month").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    by = inside.groupBy("cluster_id", "company_id").agg(F.sum("n").alias("n_total"), F.map_from_entries(F.collect_list(F.struct("period_month", F.struct("n", "share")))).alias("m"))
    at = lambda field, zero: F.transform(months, lambda d: F.coalesce(F.try_element_at(F.col("m"), d)[field], zero))
    return by.select("cluster_id", "company_id", "n_total", at("n", F.lit(0).cast("long")).alias("n"), at("share", F.lit(0.0)).alias("share"))


def densify(series: DataFrame, lo: str, hi: str) -> DataFrame:
    """(cluster_id, company_id, period_month, n, share) for each series and month from lo to hi; absent months are 0."""
    each = series_arrays(series, lo, hi).select("cluster_id", "company_id", F.posexplode(F.arrays_zip("n", "share")).alias("i", "z"))
    month = F.add_months(F.lit(lo).cast("date"), F.col("i"))
    return each.select("cluster_id", "company_id", month.alias("period_month"), "z.n", "z.share")


def trailing(dense: DataFrame, value: str = "share", months: int = 12) -> DataFrame:
    """dense plus mean and sample deviation of `value` in the `months` before each month; null while there are fewer."""
    w = Window.partitionBy("cluster_id", "company_id").orderBy("period_month").rowsBetween(-months, -1)
    full = F.count(F.lit(1)).over(w) == months
    return dense.withColumn("base_mean", F.when(full, F.avg(value).over(w))).withColumn("base_sd", F.when(full, F.stddev_samp(value).over(w)))


def signal_rows(scored: DataFrame, changes: DataFrame, supported: DataFrame, latest: str, as_of: str) -> DataFrame:
    """All signals in one form: (cluster_id, company_id, period_month, method, statistic, ci_low, ci_high, p, q, n_supporting, n_supporting_groups, as_of).

    scored (eb05, prr_low, prr_high, p, q): method ebgm, its statistic EB05, dated the last month in scope. changes (method, period_month, statistic): no interval.
    Support is distinct groups and complaints over the whole window; a pair without any has 0.
    """
    none = F.lit(None).cast("double")
    eb = scored.select(
        "cluster_id", "company_id", F.lit(latest).cast("date").alias("period_month"), F.lit("ebgm").alias("method"), F.col("eb05").alias("statistic"), F.col("prr_low").alias("ci_low"), F.col("prr_high").alias("ci_high"), "p", "q"
    )
    ch = changes.select("cluster_id", "company_id", "period_month", "method", "statistic", none.alias("ci_low"), none.alias("ci_high"), none.alias("p"), none.alias("q"))
    both = eb.unionByName(ch).join(supported, ["cluster_id", "company_id"], "left")
    zero = lambda c, to: F.coalesce(c, F.lit(0)).alias(to)
    return both.select(*eb.columns, zero("complaints", "n_supporting"), zero("groups", "n_supporting_groups"), F.lit(as_of).cast("date").alias("as_of"))


def alert_scopes(signals: DataFrame, clusters: DataFrame, min_coherence: float = MIN_COHERENCE, min_groups: int = MIN_GROUPS, alpha: float = ALPHA) -> DataFrame:
    """Signals folded to (cluster, company) scopes that alert: coherent, supported, and significant or changed. clusters has cluster_id and coherence.

    (cluster_id, company_id, eb05, q, changed, change_month, n_supporting, n_groups, and the clusters' columns); order with in_order().
    """
    change, eb = F.col("method").isin("ewma", "pelt"), F.col("method") == "ebgm"
    by = signals.where("cluster_id is not null and company_id is not null").groupBy("cluster_id", "company_id").agg(
        F.max(F.when(eb, F.col("statistic"))).alias("eb05"), F.min(F.when(eb, F.col("q"))).alias("q"), F.max(change.cast("int")).alias("changed"), F.min(F.when(change, F.col("period_month"))).alias("change_month"),
        F.max("n_supporting").alias("n_supporting"), F.max("n_supporting_groups").alias("n_groups"),
    )
    j = by.join(clusters, "cluster_id")
    return j.where((F.col("coherence") >= min_coherence) & (F.col("n_groups") >= min_groups) & (F.coalesce(F.col("q") <= alpha, F.lit(False)) | (F.col("changed") == 1)))


def in_order(scopes: DataFrame) -> DataFrame:
    """Alert scopes, the strongest first: EB05 descending with nulls last, then groups, cluster and company."""
    return scopes.orderBy(F.desc_nulls_last("eb05"), F.desc("n_groups"), "cluster_id", "company_id")


def alert_tracks(scopes: DataFrame, novel: DataFrame) -> DataFrame:
    """(track, n_scopes, n_clusters, n_companies) of the alerts in novel clusters, in known ones, and in all; novel is (cluster_id, is_novel), absent ones are known."""
    j = scopes.join(novel.select("cluster_id", "is_novel"), "cluster_id", "left")
    each = j.select("cluster_id", "company_id", F.explode(F.array(F.lit("all"), F.when(F.coalesce("is_novel", F.lit(False)), "novel").otherwise("known"))).alias("track"))
    return each.groupBy("track").agg(F.count(F.lit(1)).alias("n_scopes"), F.count_distinct("cluster_id").alias("n_clusters"), F.count_distinct("company_id").alias("n_companies"))


def false_alert_rate(tests: DataFrame, supported: DataFrame, alpha: float = ALPHA, min_groups: int = MIN_GROUPS) -> DataFrame:
    """One row (tests, alerts, rate, passes) of tests with shuffled clusters: an alert has q <= alpha and enough groups; twice alpha is too many."""
    j = tests.join(supported, ["cluster_id", "company_id"], "left")
    g = j.agg(F.count(F.lit(1)).alias("tests"), F.count_if((F.col("q") <= alpha) & (F.coalesce("groups", F.lit(0)) >= min_groups)).alias("alerts"))
    return g.select("tests", "alerts", (F.col("alerts") / F.greatest("tests", F.lit(1))).alias("rate")).withColumn("passes", F.col("rate") <= 2 * alpha)

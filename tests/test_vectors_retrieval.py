import math

import numpy as np
import pytest

from harborlight.operators import evaluation, retrieval, vectors


def _points(spark, n=60, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "id long, v array<double>, cluster int")


def test_nearest_equals_brute_force(spark):
    v, df = _points(spark)
    got = {}
    for r in vectors.nearest(df.where("id % 20 = 0"), df, 4).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    for i in (0, 20, 40):
        s = v @ v[i]
        s[i] = -9
        assert [n for _, n in sorted(got[i])] == list(np.argsort(-s)[:4])
    assert vectors.nearest(df.limit(0), df, 4).count() == 0


def test_assign_and_agreement(spark):
    v, df = _points(spark)
    c = np.array([v[np.arange(60) % 3 == k].mean(axis=0) for k in range(3)])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    got = {r.id: r.cluster for r in vectors.assign(df, vectors.centroids(df), 2.0).collect()}
    assert got == {i: int(np.argmax(c @ v[i])) for i in range(60)}
    assert all(r.cluster == -1 for r in vectors.assign(df, vectors.centroids(df).limit(0)).collect())
    same = vectors.agreement(spark.createDataFrame([(i % 3, i % 3) for i in range(30)] + [(None, 1)], "x int, y int")).first()
    assert same.ari == pytest.approx(1) and same.nmi == pytest.approx(1)


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.9, 0)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert vectors.auc(spark.createDataFrame(rows, "score double, label long")).first().auc == pytest.approx(want)
    assert vectors.auc(spark.createDataFrame([(0.1, 1)], "score double, label long")).first().auc is None


def test_bm25_rrf_and_measures(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"]), (4, [])], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(7, ["c", "d"]), (8, [])], "query_id long, tokens array<string>")
    got = retrieval.bm25(docs, q).collect()
    idf, avg = math.log((4 - 1 + 0.5) / 1.5), 6 / 4
    want = {2: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg)), 3: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1 / avg))}
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=1e-8)
    rank = spark.createDataFrame([(7, 3, 1), (7, 2, 2)], "query_id long, doc_id long, rank int")
    fused = retrieval.fuse(rank, rank.where("doc_id = 2")).collect()
    assert fused[0].doc_id == 2 and fused[0].score == pytest.approx(2 / 62)
    m = retrieval.ir_metrics(rank, spark.createDataFrame([(7, 2), (7, 9)], "query_id long, doc_id long")).first()
    assert (m.hits, m.recall, m.reciprocal_rank) == (1, 0.5, 0.5)


def test_cutoffs_and_gaps(spark):
    a = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-01-02"), (3, None)], "id int, day string")
    got = {r.id: r.cutoff for r in evaluation.asof_cutoff(a, ["2019-01-01", "2020-01-01"], "day").collect()}
    assert str(got[1]) == "2019-01-01" and str(got[2]) == "2020-01-01" and got[3] is None
    g = spark.sql("select 'f' as family, explode(array(date'2020-01-01', date'2020-03-01')) as m")
    assert [str(r.m) for r in evaluation.month_gaps(g, "family", "m").collect()] == ["2020-02-01"]

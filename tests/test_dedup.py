import random

import pytest
from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.operators import dedup
from harborlight.plans import queries


def _greedy(nodes, edges):
    near = {v: set() for v in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    order, seed = sorted(nodes, key=lambda v: (-len(near[v]), v)), {}
    seeds = []
    for v in order:
        if not any(s in near[v] for s in seeds):
            seeds.append(v)
    for v in nodes:
        seed[v] = v if v in seeds else min((s for s in seeds if s in near[v]), key=lambda s: (-len(near[s]), s))
    return seed


@pytest.mark.parametrize("case", range(3))
def test_star_equals_sequential_greedy(spark, case):
    rng = random.Random(case)
    nodes = list(range(14))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(18)]
    got = dedup.star_clusters(spark.createDataFrame([(v,) for v in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.seed for r in got.collect()} == _greedy(nodes, edges)


def test_star_does_not_chain(spark):
    got = dedup.star_clusters(spark.createDataFrame([(i,) for i in range(5)], "id long"), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (2, 2)], "a long, b long"))
    assert len({r.seed for r in got.collect()}) == 2
    assert dedup.star_clusters(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_finds_near_copies(spark):
    base = "the bureau refuses to describe the method of verification it relied on for the disputed entry in my report"
    rows = [(1, "f", base), (2, "f", base + "s"), (3, "f", "an entirely different story about a tow truck and a fence"), (4, "g", base), (5, None, ""), (6, None, "")]
    got = dedup.minhash_links(spark.createDataFrame(rows, "id long, family string, text string")).collect()
    assert {(r.a, r.b) for r in got} == {(1, 2), (5, 6)}


def test_exact_pairs(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (5, "x")], "id long, h string")
    assert {(r.a, r.b) for r in dedup.exact_pairs(df).collect()} == {(1, 3), (1, 5)}


def test_text_functions(spark):
    df = spark.createDataFrame([("Héllo, 12 34!  x", "ACME, L.L.C.", "4111 1111 1111 1111 or 12345678"), (None, None, None), ("", "Inc", "")], "t string, c string, n string")
    out, counts = T.redact(F.col("n"))
    r = df.select(T.normalize(F.col("t")).alias("t"), T.company_normal(F.col("c")).alias("c"), out.alias("n"), counts["card"].alias("cards"), T.slug(T.company_normal(F.col("c"))).alias("s")).collect()
    assert (r[0].t, r[0].c, r[0].n, r[0].cards, r[0].s) == ("héllo # # x", "ACME", "[CARD] or [ACCOUNT]", 1, "acme")
    assert r[1].t is None and r[1].n is None and r[2].c == "INC"
    s = df.select(T.shingles(F.lit("abcdef"), 5).alias("a"), T.shingles(F.lit(""), 5).alias("e"), T.jaccard(T.shingles(F.lit("abcdef"), 5), T.shingles(F.lit("abcdeg"), 5)).alias("j")).first()
    assert sorted(s.a) == ["abcde", "bcdef"] and s.e == [] and s.j == pytest.approx(1 / 3)
    assert df.select(T.spreadsheet_safe(F.lit("=1+1")).alias("x"), T.display_safe(F.lit("a\x1b[31mb\x07 c")).alias("y")).first() == ("'=1+1", "a b c")


def test_minhash_meets_across_product_labels(spark, tmp_path):
    base = "the bureau refuses to describe the method of verification it relied on for the disputed entry in my report"
    spark.createDataFrame([(1, "x", base), (2, "y", base + "s")], "complaint_id long, text_hash string, text_redacted string").write.parquet(f"{tmp_path}/narratives.parquet")
    labels = [(1, "Consumer file bureaus", None, "TX", "A"), (2, "Consumer files or other personal dossiers", None, "TX", "A")]
    spark.createDataFrame(labels, "complaint_id long, product string, date_received date, state string, company_raw string").write.parquet(f"{tmp_path}/complaints_raw.parquet")
    assert [(r.a, r.b) for r in queries.minhash_verified(spark, str(tmp_path)).collect()] == [(1, 2)]

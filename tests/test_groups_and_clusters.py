"""Groups, embeddings, clusters and built tables against brute force; nulls, ties, repeats, empty tables."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.operators import clustering, corpus, dedup, embedding, graph, grouping, review, vectors

DAY = datetime.date(2020, 1, 1)


def _day(n):
    return DAY + datetime.timedelta(days=n)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    nodes = sorted({x for e in edges for x in e if x is not None} | {999})
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == label
    assert graph.components(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("local", [0, 10, 200_000])
def test_star_is_the_greedy_whoever_decides(spark, local):
    rng = random.Random(2)
    edges = [(rng.randint(1, 40), rng.randint(1, 40)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 500)]  # a chain of rising ids, an end that is no node
    nodes = [*range(1, 41), *range(100, 131), 77]
    near = {n: {b for a, b in [*edges, *[(b, a) for a, b in edges]] if a == n and b != n and b in nodes} for n in nodes}
    order = sorted(nodes, key=lambda n: (-len(near[n]), n))
    seeds, taken = [], set()
    for n in order:
        if n not in taken:
            seeds.append(n)
            taken |= near[n]
    want = {n: n if n in seeds else next(s for s in order if s in seeds and s in near[n]) for n in nodes}
    got = dedup.star_clusters(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"), local)
    assert {r.id: r.seed for r in got.collect()} == want


def test_groups_at_a_cutoff(spark):
    texts = spark.createDataFrame([(1, "x", _day(5)), (2, "x", _day(1)), (3, "y", _day(2)), (4, "z", _day(3)), (5, "w", _day(400)), (6, "v", None)], "id long, h string, day date")
    links = spark.createDataFrame([(1, 3), (3, 4), (2, 4), (1, 5)], "a long, b long")
    got = {r.id: (r.group_id, r.group_size, r.is_representative) for r in grouping.assign_groups(texts, links, "2021-01-01").collect()}
    # 2 is a copy of 1, so its link counts for nothing; 3 has most neighbours
    assert got == {1: ("g3", 4, False), 2: ("g3", 4, True), 3: ("g3", 4, False), 4: ("g3", 4, False)}
    assert grouping.assign_groups(texts, links).count() == 6 and grouping.assign_groups(texts.limit(0), links).count() == 0
    assert {r.group_id for r in grouping.identity_groups(texts, "2021-01-01").collect()} == {"g1", "g2", "g3", "g4"}


def test_links_and_evaluation(spark):
    found = spark.createDataFrame([(2, 1, 0.9), (1, 2, 0.95), (3, 3, 1.0), (4, 5, 0.8), (6, 7, None)], "a long, b long, similarity double")
    assert {tuple(r) for r in grouping.new_links(found, spark.createDataFrame([(5, 4)], "a long, b long")).collect()} == {(1, 2, 0.95), (6, 7, None)}
    texts = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgx"), (3, None), (4, "abc"), (5, "abc")], "id long, text string")
    pairs = spark.createDataFrame([(1, 2, "hard"), (1, 3, "hard"), (4, 5, "obvious"), (1, 4, "unrelated")], "a long, b long, stratum string")
    lab = {(r.a, r.b): (r.true_jaccard, r.is_dup) for r in grouping.label_pairs(pairs, texts).collect()}
    assert lab == {(1, 2): (0.6, False), (4, 5): (1.0, True), (1, 4): (0.0, False)}
    groups = spark.createDataFrame([(1, "g1"), (2, "g1"), (4, "g4"), (5, "g4")], "id long, group_id string")
    judged = grouping.same_group(grouping.label_pairs(pairs, texts), groups)
    got = {r.stratum: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in grouping.gate_report(judged).collect()}
    assert got["all"] == (1, 1, 0, 0.5, 1.0) and got["unrelated"] == (0, 0, 0, None, None)
    big = spark.createDataFrame([(i, "g") for i in range(12)] + [(50, "small")], "id long, group_id string")
    audit = grouping.merge_audit(big, spark.createDataFrame([(a, b) for a in range(12) for b in range(a)], "a long, b long"), "s", 10).collect()
    assert len(audit) == 1 and audit[0].direct and audit[0].a < audit[0].b
    drawn = grouping.evaluation_pairs(spark.createDataFrame([(i, i + 1, 0.7 + i / 100) for i in range(31)], "a long, b long, similarity double"), spark.createDataFrame([(i, "f") for i in range(40)] + [(99, None)], "id long, family string"), "s", 5)
    n = {r.stratum: r["count"] for r in drawn.groupBy("stratum").count().collect()}
    assert n == {"obvious": 3, "hard": 5, "unrelated": 5} and drawn.join(drawn.where("stratum = 'unrelated'").select("a", "b"), ["a", "b"]).where("stratum <> 'unrelated'").count() == 0


def test_campaigns(spark):
    rows = [("g", i, _day(0), "f", "CA", "acme", 100, "cease and desist") for i in range(25)] + [("h", 100 + i, _day(i), "f", "SC"[i % 2], f"c{i}", 100 + 40 * i, "plain") for i in range(25)] + [("k", 200, _day(1), None, None, None, None, None)]
    m = spark.createDataFrame(rows, "group_id string, id long, day date, family string, state string, company string, char_len int, text string")
    c, members = grouping.build_campaigns(m)
    got = {r.group_id: r for r in c.collect()}
    assert set(got) == {"g", "h"} and got["g"].flagged and not got["h"].flagged and got["g"].top_company == "acme" and members.count() == 50
    share = {r.family: (r.n, r.n_flagged) for r in grouping.flagged_share(m, c.where("flagged")).collect()}
    assert share == {"f": (50, 25), None: (1, 0)}


def test_embedding_rows_and_encoder(spark):
    t = spark.createDataFrame([(i, f"h{i % 7}", f"text {i % 7}", "clash") for i in range(20)] + [(99, None, "x", "clash")], "id long, h string, text string, row_idx string")
    rows = embedding.distinct_texts(t.select("h", "text"))
    assert {r.h: r.row_idx for r in rows.collect()} == {f"h{i}": i for i in range(7)}
    m = embedding.embedding_map(t.select("id", "h"), rows, "m", 64)
    assert m.count() == 20 and embedding.coverage(t.where("h is not null").select("id"), m).first() == (20, 20, 7, True)
    assert embedding.pending(rows, rows.where("row_idx < 3")).count() == 4
    docs = spark.createDataFrame([(1, "a b a"), (2, "A. B; a!"), (3, ""), (4, None), (5, "word " * 3000), (6, "zz")], "k long, t string")
    v = {r.k: np.array(r.v) for r in embedding.encode(docs, "k", "t").collect()}
    assert set(v) == {1, 2, 3, 5, 6} and np.allclose(v[1], v[2]) and not v[3].any() and np.linalg.norm(v[5]) == pytest.approx(1)


def test_density_clusters(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(6)[:3]
    pts = [c + rng.normal(0, 0.05, 6) for c in centres for _ in range(20)] + [rng.normal(0, 1, 6) for _ in range(5)]
    rows = [(i, [float(x) for x in p / np.linalg.norm(p)]) for i, p in enumerate(pts)]
    got = {r.id: r.cluster for r in clustering.density_clusters(spark.createDataFrame(rows, "id long, v array<double>"), 5, 0.9, 10).collect()}
    assert [len({got[i] for i in range(k * 20, k * 20 + 20)}) for k in range(3)] == [1, 1, 1] and {got[0], got[20], got[40]} == {0, 1, 2} and all(got[i] == clustering.NOISE for i in range(60, 65))
    assert clustering.density_clusters(spark.createDataFrame([], "id long, v array<double>")).count() == 0
    p = spark.createDataFrame([(*r, int(got[r[0]])) for r in rows if got[r[0]] >= 0], "id long, v array<double>, cluster int")
    assert clustering.stability(p, "s").first().ari == pytest.approx(1.0)


def test_mmr_is_the_greedy(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(30, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    pts = spark.createDataFrame([(i, [float(x) for x in p], i % 2) for i, p in enumerate(v)], "id long, v array<double>, cluster int")
    centres = vectors.centroids(pts)
    cs = {r.cluster: np.array(r.centroid) for r in centres.collect()}
    got = {}
    for r in vectors.mmr_select(pts, centres, 2, 6).collect():
        got.setdefault(r.cluster, {})[r.nth] = r.id
    for c in (0, 1):
        ids = [i for i in range(30) if i % 2 == c]
        near = {i: round(float(v[i] @ cs[c]), 9) for i in ids}
        chosen = sorted(ids, key=lambda i: (-near[i], i))[:2]
        while len(chosen) < 6:
            value = {i: round(0.5 * near[i] - 0.5 * max(round(float(v[i] @ v[j]), 9) for j in chosen), 9) for i in ids if i not in chosen}
            chosen.append(min(value, key=lambda i: (-value[i], i)))
        assert [got[c][k] for k in range(1, 7)] == chosen


def test_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], i % 4) for i in range(80)] + [(900, None, 1)], "id long, v array<double>, cluster int")
    good = pts.where("v is not null")
    centres = vectors.centroids(good)
    fam = centres.select("cluster", (F.col("cluster") % 2).cast("string").alias("family"))
    rounded = lambda x: sorted(tuple(round(c, 9) for c in r) for r in x.collect())
    one = [rounded(x) for x in (vectors.nearest(pts, pts, 3), vectors.assign(good, centres, 2.0), vectors.related(centres, fam, -1.0))]
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 64)
    two = [rounded(x) for x in (vectors.nearest(pts, pts, 3), vectors.assign(good, centres, 2.0), vectors.related(centres, fam, -1.0))]
    assert one == two and len(one[0]) == 240
    assert vectors.nearest(pts.limit(0), pts, 3).count() == 0 and {r.cluster for r in vectors.assign(good, centres.limit(0)).collect()} == {-1}


def test_units_and_exemplars(spark):
    m = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "x"), (4, "b", "x"), (4, "b", "x")], "id long, p string, q string")
    numbered, member = clustering.units(m, ["p", "q"], "id")
    assert [(r.unit, r.p, r.q, r.n_members) for r in numbered.orderBy("unit").collect()] == [(0, None, "x", 1), (1, "a", None, 2), (2, "b", "x", 1)]
    assert {(r.id, r.unit) for r in member.collect()} == {(1, 1), (2, 1), (3, 0), (4, 2)}
    e = spark.createDataFrame([(0, i, i == 9, i / 10) for i in range(30)] + [(1, 50, False, None)], "cluster int, id long, is_exemplar boolean, prob double")
    assert [(r.cluster, r.id) for r in clustering.exemplars(e, 3).orderBy("cluster", "nth").collect()] == [(0, 9), (0, 29), (0, 28), (1, 50)]


def test_built_tables(spark):
    raw = spark.createDataFrame([(1, _day(3), "Home loans", None, "i", None, "ACME", "CA", None, None, True)] * 2 + [(2, _day(-9999), "Home loans", None, "i", None, "ACME", "CA", None, None, True), (3, None, None, None, None, None, None, None, None, None, None), (None, _day(1), None, None, None, None, None, None, None, None, None)],
        "complaint_id long, date_received date, product string, sub_product string, issue string, sub_issue string, company_raw string, state string, tags string, company_response string, has_narrative boolean")
    alias = spark.createDataFrame([("ACME", "acme", 1.0)], "alias_raw string, company_id string, score double")
    got = corpus.build_complaints(raw, alias).collect()
    assert {r.complaint_id for r in got} == {1, 2, 3} and len(got) == 3 and [r.company_id for r in got if r.complaint_id == 3] == [None]
    assert [r.complaint_id for r in corpus.build_complaints(raw, alias, "2019-01-01").collect()] == [1]
    assert corpus.reconcile(raw, raw, "complaint_id", 0.1).first()[2:] == (1, 0.2, False)
    n = corpus.build_narratives(spark.createDataFrame([(1, "mail a@b.cc now"), (2, "  "), (3, None)], "id long, t string"), "id", "t")
    assert [(r.id, r.text_redacted, r.redaction_count) for r in n.collect()] == [(1, "mail [EMAIL] now", 1)]
    assert {r.pattern: (r.n_hits, r.n_documents) for r in corpus.redaction_stats(n).collect()}["email"] == (1, 1)
    assert {r.n_hits for r in corpus.redaction_stats(n.limit(0)).collect()} == {0}


def test_review(spark):
    c = spark.createDataFrame([(f"c{i}", 20 + i) for i in range(30)], "cluster_id string, n_members long")
    p = review.label_population(c, spark.createDataFrame([("c29",), ("c1",), ("c29",)], "cluster_id string"), "s", 4)
    assert p.where("fired").count() == 1 and p.count() == 5 and p.where("n_members < 30").count() == 0
    d = review.stratified_draw(spark.createDataFrame([(i, i % 3) for i in range(90)] + [(500, None)], "id long, g int"), ["g"], "id", "s", 4)
    assert sorted(r["count"] for r in d.groupBy("g").count().collect()) == [1, 4, 4, 4]
    v = spark.createDataFrame([(1, True, "x"), (1, False, None), (2, None, "x")], "id long, ok boolean, tag string")
    a = {(r.dimension, r.value): (r.n_items, r.n, r.n_agreed) for r in review.agreement_report(v, ["tag"], "id", "ok").collect()}
    assert a == {("overall", "all"): (1, 2, 1), ("tag", "x"): (1, 1, 1), ("tag", "-"): (1, 1, 0)}
    old, new = spark.createDataFrame([("k", "yes")], "k string, v string"), spark.createDataFrame([("k", "no"), ("l", "yes"), ("l", "no")], "k string, v string")
    assert {tuple(r) for r in review.record(old, new, ["k"], {"v": ["yes", "no"]}).collect()} == {("k", "yes"), ("l", "no")}
    with pytest.raises(ValueError):
        review.record(old, new, ["k"], {"v": ["yes"]})
    q = spark.createDataFrame([("What  is\nit?",), ("what is it",), ("a​b",), ("",), (None,)], "q string").select(review.question_hash(F.col("q")).alias("h")).collect()
    assert q[0].h == q[1].h and [r.h for r in q[2:]] == [None, None, None]
    e = review.context(spark.createDataFrame([(i, "c", _day(i)) for i in range(9)] + [(50, "c", None), (51, None, _day(1))], "id long, c string, d date"), "c", "d", "id", 3)
    assert [r.id for r in e.orderBy("nth").collect()] == [8, 7, 6]

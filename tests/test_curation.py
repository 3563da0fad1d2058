import random

import pytest
from harborlight.operators import curation, evaluation
from pyspark.sql import functions as F


def test_unique_prefix(spark):
    c = spark.createDataFrame([("a", "ACME BANK"), ("b", "ACME MORTGAGE"), ("c", "ZETA BANK CORP"), ("c", "ZETA BANK")], "company_id string, normal string")
    n = spark.createDataFrame([("Acme",), ("acme bank",), ("ZETA",), ("Nobody",), (None,), ("",)], "name string")
    assert {r.name: r.company_id for r in curation.unique_prefix(n, c).collect()} == {"Acme": None, "acme bank": "a", "ZETA": "c", "Nobody": None, "": None}
    assert curation.unique_prefix(n.limit(0), c).count() == 0


def test_merge_review_is_all_pairs_of_the_largest(spark):
    rng = random.Random(4)
    words = ["ACME", "ACMES", "ZETA", "ZEAT", "LOANS", "BANK", "CREDIT", "UNION", "GROUP", "FIRST"]
    names = [(f"c{i:03}", " ".join(rng.sample(words, rng.randint(1, 4))), rng.randint(1, 50)) for i in range(120)] + [("none", None, 99), ("blank", "", 98)]
    c = spark.createDataFrame(names, "company_id string, name string, n_complaints long")
    largest = sorted([x for x in names if x[1] is not None], key=lambda x: (-x[2], x[0]))[:80]
    want = {(a[0], b[0], int(curation.token_set_ratio(a[1], b[1]))) for i, a in enumerate(largest) for b in largest[i + 1 :] if curation.token_set_ratio(a[1], b[1]) >= 88}
    assert {(r.id_a, r.id_b, r.score) for r in curation.merge_review(c, 80).collect()} == want and want
    # one misspelt word beside common words is met, too
    assert curation.token_set_ratio("WOKRUSESEKRUR CREDIT UNION", "WOKRUSESELRUR CREDIT UNION") >= 88
    assert curation.token_set_ratio("SELENE", "SELENE FINANCE") == 100 and curation.token_set_ratio("", "A") == 0 and curation.merge_review(c.limit(0)).count() == 0


def test_worklist_hides_and_is_stable(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), spark.createDataFrame([("z",), ("x",), ("w",), ("v",)], "k string")
    one, two = (curation.blinded_worklist(p, b, "k", "s", 2).collect() for p in (a, a.orderBy("k")))
    assert one == two and len(one) == 4 and set(one[0].asDict()) == {"position", "k"} and {"x", "y"} < {r.k for r in one}
    assert curation.blinded_worklist(a.limit(0), b.limit(0), "k", "s", 2).count() == 0


def test_latest_run_and_audit(spark):
    runs = spark.createDataFrame([("r1", "d", "ok", 1, '{"params":{"cutoff":"2020"}}'), ("r2", "d", "ok", 2, '{"params":{}}'), ("r3", "d", "failed", 3, '{"params":{"cutoff":"2020"}}')], "run_id string, stage string, status string, started_at int, params_json string")
    assert curation.latest_run(runs, "d", {"cutoff": "2020"}).first().run_id == "r1" and curation.latest_run(runs, "d", {}).first().run_id == "r2"
    m, e = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "id long, seed long"), spark.createDataFrame([(2, 1), (3, 2)], "a long, b long")
    assert {tuple(r) for r in curation.merge_audit(m, e).collect()} == {(1, 3, 1), (9, 1, 0)}


def test_grounded(spark):
    ev = spark.createDataFrame([(1, 10, "they  charged\na fee"), (1, 11, "nothing")], "answer_id int, id int, text string")
    cl = spark.createDataFrame([(1, "charged a fee", [10]), (1, "charged a fee", [11]), (1, "charged a fee", [10, 99]), (1, "", [10]), (1, "nothing", [])], "answer_id int, claim string, cited array<int>")
    assert [r.grounded for r in curation.grounded(cl, ev).collect()].count(True) == 1


def test_display_and_strict_measures(spark):
    d = spark.createDataFrame([("a  b\n" + "c" * 30,), ("short",), (None,)], "t string").select(curation.one_line(F.col("t"), 10).alias("t"))
    assert [r.t for r in d.collect()] == ["a b ccccc…", "short", None]
    s = spark.createDataFrame([(True, False), (False, False)], "predicted boolean, actual boolean")
    assert evaluation.precision_recall(s).first().recall is None
    with pytest.raises(ValueError):
        evaluation.precision_recall(s, strict=True)

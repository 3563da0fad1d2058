"""Exact ways beside the indexes, and surrogates: each against brute force or a stated invariant."""

import itertools
import random
import string
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import consistent, leakage, names, neardup, packing, pii

KEY = b"test key"


def _edits(core: str, rng: random.Random) -> set[str]:
    out = {core[:i] + core[i + 1 :] for i in range(len(core))} | {core[:i] + core[i + 1] + core[i] + core[i + 2 :] for i in range(len(core) - 1)}
    out |= {core[:i] + rng.choice(string.ascii_lowercase) + core[i:] for i in range(len(core) + 1)} | {core[:i] + rng.choice(string.ascii_lowercase) + core[i + 1 :] for i in range(len(core))}
    return {x for x in out if x and x != core}


@pytest.mark.parametrize("common", [200, 1])
def test_single_edits_of_short_and_common_names_are_met(spark, monkeypatch, common):
    monkeypatch.setattr(names, "COMMON", common)  # 1: every shared suffix counts as common
    rng = random.Random(5)
    cores = ["".join(rng.choice("aeiou" if i % 2 else "bcdgklmnrst") for i in range(n)) for n in (*range(4, 16), 22, 24, 27)]
    all_ = sorted({*cores, *(e for c in cores for e in _edits(c, rng) if len(c) < 20 or rng.random() < 0.4)})
    got = {(r.core_a, r.core_b) for r in names._similar_cores(spark.createDataFrame([("s", c) for c in all_], "scope string, core string"), names.RATIO).collect()}
    for core in cores:
        for e in _edits(core, rng) & set(all_):
            pair = tuple(sorted((core, e)))
            assert (pair in got) == (names.lcs_ratio(*pair) >= names.least_ratio(*pair, names.RATIO) - 1e-12), pair
    # edits of edits, too: two letters on either side
    want = {(a, b) for i, a in enumerate(all_) for b in all_[i + 1 :] if names.lcs_ratio(a, b) >= names.least_ratio(a, b, names.RATIO) - 1e-12}
    assert got == want


def test_changed_letter_in_a_short_name():
    assert names.lcs_ratio("wells", "wellz") >= names.least_ratio("wells", "wellz", names.RATIO) - 1e-12
    assert names.lcs_ratio("santand", "santant") >= names.least_ratio("santand", "santant", names.RATIO) - 1e-12
    assert names.lcs_ratio("bells", "wells") < names.least_ratio("bells", "wells", names.RATIO) and names.lcs_ratio("acme", "acne") < names.least_ratio("acme", "acne", names.RATIO)


def test_every_code_point_is_scanned():
    known = {i for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Co", "Cs")}
    assert known <= set(consistent._SCANNED) | set(range(0xE000, 0xF900))
    assert consistent.consistent("\U0001fbf0") == "0" and consistent.consistent("a\U0002f800b") == "a丽b"
    rng = random.Random(2)
    for c in map(chr, rng.sample(sorted(known), 4000)):
        once = consistent.consistent(f"ab{c}cd")
        assert consistent.consistent(once) == once and consistent.consistent_with_offsets(f"ab{c}cd")[0] == once


def test_more_test_words_than_a_plane_holds_and_several_automata(spark, monkeypatch):
    words = [f"w{i}" for i in range(140_000)]
    items = [(i, " ".join(words[i * 14_000 : (i + 1) * 14_000])) for i in range(10)]
    auto = leakage.Automaton(items)
    text = "Start. " + " ".join(words[139_000:139_015]) + " <a href='" + "x" * 400 + "'>" + " ".join(words[139_015:139_020]) + " end"
    assert [(i, n) for i, _, _, n in auto.scan(text)] == [(9, 20)]
    docs = spark.createDataFrame([(1, text), (2, " ".join(words[5:40])), (3, None), (4, "")], "d long, t string")
    held = spark.createDataFrame([*items, (99, None), (None, "x")], "i long, t string")
    one = {tuple(r) for r in leakage.leaked_passages(docs, "d", "t", held, "i", "t").collect()}
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 150_000)
    assert len(leakage._shards(held.where("i is not null and t is not null"))) > 3
    assert {tuple(r) for r in leakage.leaked_passages(docs, "d", "t", held, "i", "t").collect()} == one and {(r[0], r[1]) for r in one} == {(1, 9), (2, 0)}
    assert leakage.leaked_passages(docs, "d", "t", held.limit(0), "i", "t").count() == 0


def test_bound_from_counts_loses_nothing():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(n)) for n in (6, 30, 400, 3000)] + ["ab" * 40]
    rows = []
    for t in base:
        for k in (0, 1, 3, 30):
            u = list(t)
            for _ in range(k):
                u[rng.randrange(len(u))] = rng.choice("xyz")
            rows.append((t, "".join(u)))
    import pandas as pd

    h = [(np.unique(neardup.char_shingles(a)), np.unique(neardup.char_shingles(b))) for a, b in rows]
    pdf = pd.DataFrame({"rep_a": range(len(h)), "rep_b": range(len(h)), "sketch_a": [neardup._sketch(a) for a, _ in h], "sketch_b": [neardup._sketch(b) for _, b in h], "n_a": [len(a) for a, _ in h], "n_b": [len(b) for _, b in h]})
    kept = set(next(neardup._may_reach(0.8)(iter([pdf])))["rep_a"])
    for i, (a, b) in enumerate(rows):
        x, y = neardup.pieces(a, 5), neardup.pieces(b, 5)
        if len(x & y) / len(x | y) >= 0.8:
            assert i in kept


def test_weighted_shingles(spark):
    x, y = Counter("aaaabbc"), Counter("aabbbd")
    assert neardup._probability(x, y) == pytest.approx(neardup.probability_jaccard(x, y)) and neardup.probability_jaccard({"a": 2}, {"a": 5}) == 1
    # registers agree as often as the probability Jaccard similarity says
    e = [np.array(sorted({ord(c) for c in s}), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in ("abc", "abd")]
    w = [np.array([x[c] for c in "abc"], float), np.array([y[c] for c in "abd"], float)]
    hit = np.mean([(lambda g: (g[0] == g[1]).mean())(neardup.signatures(np.concatenate(e), np.concatenate(w), np.array([0] * 3 + [1] * 3), 2, 400, seed) & np.uint64(0xFFFFFFFF)) for seed in range(20)])
    assert hit == pytest.approx(neardup.probability_jaccard(x, y), abs=0.03)
    t = "the fee was charged twice and then the fee was charged again and nobody would say why the fee was charged"
    rows = [(1, t), (2, t.replace("nobody", "no one")), (3, "something else altogether in this one"), (4, None), (5, ""), (6, t)]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", counted=True)
    got = {(r.rep_a, r.rep_b): r.similarity for r in links.collect()}
    folded = {i: consistent.folded(s) for i, s in rows if s}
    count = lambda s: Counter(s[i : i + 5] for i in range(len(s) - 4))
    assert set(got) == {(1, 2)} and got[1, 2] == pytest.approx(neardup.probability_jaccard(count(folded[1]), count(folded[2])))
    assert {(r.id, r.rep) for r in members.collect()} == {(1, 1), (2, 2), (3, 3), (6, 1)}


def _one(kind, value):
    return pii.substitute(kind, value, {p: pii._draw(KEY, *p, 0) for p in pii.parts(kind, value)})


def test_surrogates_keep_type_format_script_and_coreference():
    a, b = _one("email", "john.s@acme.com"), _one("email", "john.s@other.org")
    assert a != b and a.split("@")[0] == b.split("@")[0] and _one("email", "john.s [at] acme [dot] com").split()[2] == a.split("@")[1].split(".")[0]
    assert _one("phone", "1-555-123-4567")[2:] == _one("phone", "555-123-4567") and _one("phone", "(555) 123-4567").replace("(", "").replace(") ", "-") == _one("phone", "555-123-4567")
    flat, house = _one("address", "12 Oak Ave Apt 4"), _one("address", "12 Oak Avenue")
    assert flat.split(" Ave Apt ")[0] == house[: -len(" Avenue")] and not flat.endswith(" 4") and _one("address", "12 Oak St").split()[:-1] != house.split()[:-1]
    assert len({pii._draw(KEY, "initial", c, 0) for c in string.ascii_lowercase}) == 26 and all(pii._draw(KEY, "initial", c, 0) != c for c in string.ascii_lowercase)
    for name, script in (("Иван Петров", "CYRILLIC"), ("Γιώργος Παππάς", "GREEK"), ("王 小明", "CJK"), ("Maria O'Neil", "LATIN")):
        new = _one("name", name)
        assert new != name and all(unicodedata.name(c).split()[0] == script for c in new if c.isalpha())
    assert pii._draw(KEY, "given_f", "maria", 0).endswith(tuple(pii._ENDINGS["f"])) and _one("name", "MARIA SMITH").isupper()
    card = _one("card", "4111-1111-1111-1111")
    assert card[4] == card[9] == "-" and pii.luhn(card.replace("-", ""))


def test_surrogates_are_distinct_and_never_real(spark):
    drawn = {pii._draw(KEY, "surname", f"name{i}", 0) for i in range(200)}
    # real surnames that are what others would draw, and all listed given names
    parts = [("surname", f"name{i}") for i in range(200)] + [("surname", s) for s in sorted(drawn)] + [("given_" + g, n) for n, g in pii.GENDER.items()] + [("phone", f"555123{i:04}") for i in range(300)] + [("initial", c) for c in string.ascii_lowercase]
    rows = [([c], [p]) for c, p in parts]
    got = pii.surrogates(spark.createDataFrame(rows, "cls array<string>, part array<string>"), KEY).collect()
    assert len(got) == len(set(parts))
    for space in ("name", "phone"):
        mine = [r for r in got if (r.cls.startswith("given_") or r.cls == "surname") == (space == "name") and r.cls != "initial"]
        assert len({r.surrogate for r in mine}) == len(mine) and not {r.surrogate for r in mine} & {r.part for r in mine}
    with pytest.raises(ValueError):  # ten accounts of one digit can't all be replaced by others
        pii.surrogates(spark.createDataFrame([(["account"], [str(i)]) for i in range(10)], "cls array<string>, part array<string>"), KEY, rounds=3).collect()


def test_packing_is_verified(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + 37 * i % 900)) for i in range(60)] + [(100, "long " * 5000), (101, ""), (102, None)], "doc_id long, text string")
    packed = packing.pack(docs, "doc_id", "text")
    got = {r.doc_id: (r.in_order, r.fits, r.whole) for r in packing.verified(packed, "doc_id").collect()}
    assert set(got) == {*range(60), 100} and set(got.values()) == {(True, True, True)}
    broken = packed.withColumn("container_offset", F.when(F.col("doc_id") == 7, F.col("container_offset") + 1).otherwise(F.col("container_offset")))
    assert not all(r.fits for r in packing.verified(broken, "doc_id").collect())
    assert packing.verified(packed.limit(0), "doc_id").count() == 0


def test_forms_of_cores_are_never_broadcast(spark, tmp_path):
    """A file of cores is far smaller than what is exploded from it, by which Spark would choose a broadcast."""
    rng = random.Random(4)
    letters = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(8, 16)))
    cores = [letters() for _ in range(300)]
    cores += [c[:3] + "z" + c[4:] for c in cores]
    spark.createDataFrame([("s", c) for c in cores], "scope string, core string").write.parquet(str(tmp_path / "cores"))
    spark.createDataFrame([(i // 3, c) for i, c in enumerate(cores)], "group_id long, alias string").write.parquet(str(tmp_path / "groups"))
    got = names._similar_cores(spark.read.parquet(str(tmp_path / "cores")), names.RATIO)
    pairs = names.variant_pairs(spark.read.parquet(str(tmp_path / "groups")))
    assert {tuple(sorted((c, d))) for c, d in zip(cores[:300], cores[300:]) if c != d} <= {(r.core_a, r.core_b) for r in got.collect()}
    assert pairs.count() == sum(1 for i in range(0, 600, 3) for a, b in itertools.combinations(cores[i : i + 3], 2) if a != b)
    for df in (got, pairs):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

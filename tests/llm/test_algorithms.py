import itertools
import random

import numpy as np
import pytest

from harborlight.llm import abuse, components, linkage, names, neardup, packing


def _components(pairs):
    up = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {v: find(v) for v in up}


@pytest.mark.parametrize("shape", ["mixed", "chain", "sorted_chain", "star_with_tail", "empty", "selfs"])
def test_components(spark, shape):
    rng = random.Random(5)
    ids = list(range(100, 190))
    rng.shuffle(ids)
    pairs = {
        "mixed": [(rng.choice(ids), rng.choice(ids)) for _ in range(70)] + [(3, None), (None, 4), (None, None), (8, 8)], "chain": list(zip(ids, ids[1:])), "sorted_chain": [(i, i + 1) for i in range(60)],
        "star_with_tail": [(500, i) for i in range(40)] + [(1000 + i, 1001 + i) for i in range(30)] + [(7, 1000)] * 3, "empty": [], "selfs": [(1, 1), (1, 1), (2, 2)],
    }[shape]
    df = spark.createDataFrame(pairs, "x long, y long").selectExpr("x", "y", "1 as a", "2 as v", "3 as group_id")
    for peel, local in ((True, 0), (True, 200_000), (False, 0), (False, 10)):
        got = components.connected_components(df, "x", "y", peel, local)
        rows = [(r.id, r.group_id) for r in got.collect()]
        assert len(rows) == len(set(rows)) and dict(rows) == _components(pairs)
        if shape not in ("mixed", "star_with_tail") and local:
            break


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.5, 0.8):
        keep = int(400 * share)
        b = np.concatenate([a[:keep], rng.integers(0, 2**63, 400 - keep).astype(np.uint64)])
        sig = neardup.signatures(np.concatenate([a, b]), np.ones(800), np.repeat([0, 1], 400), 2, 2048)
        want = keep / (800 - keep)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    # weights: probability Jaccard of one shared element of weight 3 beside own ones of weight 1
    e, w = np.array([1, 2, 1, 3], np.uint64), np.array([3.0, 1.0, 3.0, 1.0])
    sig = neardup.signatures(e * np.uint64(7919), w, np.array([0, 0, 1, 1]), 2, 4096)
    assert abs(((sig[0] & np.uint64(0xFFFFFFFF)) == (sig[1] & np.uint64(0xFFFFFFFF))).mean() - 3 / 5) < 0.04


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=60)
        rows.append((i * 10, " ".join(words)))
        for j in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((i * 10 + j + 1, " ".join(copy).upper() + "!" * j))
    rows += [(9001, None), (9002, ""), (9003, "!!"), (9004, "abc"), (9005, "ABC."), (9006, "abcd"), (9007, "x 123 y z"), (9008, "x 9 y z"), (None, "abc"), (9009, "z" * 50_000), (9010, "z" * 40_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "complaint_id long, t string, rep int, folded string")
    members, links = neardup.near_duplicates(df, "complaint_id", "t")
    got = [(r.complaint_id_a, r.complaint_id_b) for r in neardup.all_pairs(members, links).collect()]
    sets = {i: neardup.pieces(neardup.folded(t), 5) for i, t in rows if i is not None and t is not None}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want
    classes = neardup.classes(members, links).collect()
    assert {r.id for r in classes} == {i for i, s in sets.items() if s}
    assert neardup.near_duplicates(df.limit(0), "complaint_id", "t")[0].count() == 0


def test_names(spark):
    same = [
        ["Trewase Tufrux Mortgage Inc.", "TREWASE TUFFRUX MORTGAGE INC.", "Trewase-Tufrux Mtg", "Mortgage, Trewase Tufrux LLC", "Trеwase Tufrux Mortgаge", "The Mortgage - Trewase Tufrux Company"],
        ["Trewase Tufrux Bank"], ["Nivo Dukruplul Student Servicing d/b/a Nukrikuzubox", "Nukrikyzubox", "NVO DUKRUPLUL STUDENT SVCG", "NivoDukruplul Student Servicing"],
        ["Law Offices of Samuel W. Wilopuskastux", "S. W. Wilopuskastux, Attorney at Law", "Wilopuskastux, Sam W. (Attorney)", "Sam Wilopuskastx, Esq."], ["Deb Wilopuskastux Law", "Deborah Wilopuskastux, Esq."],
        ["Ted Badrufredewos, Esq.", "LAW OFFC BADRUFREDEWOS THEODORE"],
    ]
    typed = [(a, "x") for g in same for a in g] + [(None, "x"), ("", "x"), ("  ", "x"), ("Inc", "x"), ("Trewase Tufrux Bank", "y"), ("Q" * 5000 + " Bank", "z")]
    got = names.link_variants(spark.createDataFrame(typed, "alias_raw string, alias string"), "alias_raw")
    groups = {}
    for r in got.collect():
        groups.setdefault(r.group_id, set()).add(r.alias)
    assert {frozenset(g) for g in same} <= {frozenset(g) for g in groups.values()}
    pairs = names.variant_pairs(got).collect()
    assert all(r.alias_a < r.alias_b for r in pairs) and len(pairs) == sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    assert names.link_variants(spark.createDataFrame([], "alias_raw string"), "alias_raw").count() == 0


def test_lcs_ratio():
    def slow(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return 2 * t[-1, -1] / (len(a) + len(b))

    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in "ab")
        assert names.lcs_ratio(a, b) == pytest.approx(slow(a, b))
    assert names.lcs_ratio("", "a") == 0


@pytest.mark.parametrize("local", [0, 20, 200_000])
def test_linkage_equals_sequential_average_linkage(spark, local):
    rng = random.Random(3)
    nodes = {f"n{i:02d}": rng.randint(1, 5) for i in range(18)}
    edges = {(a, b): round(rng.random() * nodes[a] * nodes[b], 6) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.35}
    clusters = [[n] for n in nodes]
    total = lambda x, y: sum(edges.get((min(a, b), max(a, b)), 0) for a in x for b in y)
    mean = lambda x, y: total(x, y) / (sum(nodes[a] for a in x) * sum(nodes[b] for b in y))
    while True:
        best = max(((mean(x, y), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(clusters), 2)), default=(0, 0, 0))
        if best[0] < 0.2:
            break
        clusters[best[1]] += clusters.pop(best[2])
    graph = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a string, b string, total double")
    got = linkage.reciprocal_linkage(graph, spark.createDataFrame(list(nodes.items()), "node string, n long"), 0.2, local)
    found = {}
    for r in got.collect():
        found.setdefault(r.cluster, set()).add(r.node)
    assert {frozenset(c) for c in found.values()} == {frozenset(c) for c in clusters} and all(c == min(v) for c, v in found.items())


def test_associations_are_those_beyond_chance(spark):
    rng = random.Random(5)
    rows = [(i, [f"n{rng.randint(0, 30)}" for _ in range(6)] + ([f"a{rng.randint(0, 3)}", f"b{rng.randint(0, 3)}"] if i % 10 == 0 else [])) for i in range(3000)]
    df = spark.createDataFrame([(i, list(dict.fromkeys(k))) for i, k in rows], "id long, keys array<string>")
    edges, _ = linkage.associations(df)
    assert {(r.f[0], r.g[0]) for r in edges.collect()} == {("a", "b")} and edges.count() >= 12  # noise meets noise about 100 times a pair, by chance
    assert linkage.associations(df.limit(0))[0].count() == 0


def test_groups_dont_depend_on_the_size_of_the_table(spark):
    rng = random.Random(8)
    themes = {t: [f"{w} {t} {k} thing happened to my {t} account." for k, w in enumerate(["The", "My", "Their", "Some", "No", "Every", "Any", "Each"])] for t in ("escrow", "parcel", "ticket")}

    def record(t):
        s = rng.sample(themes[t], 4) + [" ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(12)).capitalize() + "." for _ in range(3)]
        return " ".join(rng.sample(s, len(s)))

    rows = [(i, record(list(themes)[i % 3])) for i in range(900)]  # each theme holds a third of all records

    def split(table):
        return {r.id: r.cluster for r in linkage.cluster_records(spark.createDataFrame(table, "id long, t string"), "id", "t")[0].collect()}

    small = split(rows)
    copies = split(rows + [(i + 1000 * k, t) for i, t in rows for k in range(1, 10)])
    other = split(rows + [(i + 1000, record(list(themes)[i % 3])) for i in range(2700)])
    assert all(copies[i] == copies[i + 1000 * k] for i, _ in rows for k in range(1, 10))
    for more in (copies, other):
        assert len({(small[i], more[i]) for i, _ in rows}) == 3 and None not in {more[i] for i, _ in rows}


def test_records_by_theme(spark):
    rng = random.Random(8)
    themes = {t: [f"{w} {t} {k} thing happened to my {t} account." for k, w in enumerate(["The", "My", "Their", "Some", "No", "Every", "Any", "Each"])] for t in ("escrow", "parcel", "ticket")}
    noise = [f"On day {{}} the {w} was {{}} and nothing else." for w in ("sky", "sea", "road", "barn", "lamp", "goat")]
    rows, truth = [], {}
    for i in range(600):
        t = rng.choice([*themes, None])
        s = rng.sample(themes[t], 4) if t else []
        s += [rng.choice(noise).format(rng.randint(1, 99), rng.choice("red green blue".split())) for _ in range(3)]
        # enough of its own that records of one theme aren't near-duplicates, which count once
        s += [" ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(12)) + "." for _ in range(3)]
        rng.shuffle(s)
        truth[i] = t
        rows.append((i, " ".join(x[0].upper() + x[1:] for x in s)))
    rows += [(1000, None), (1001, ""), (1002, rows[0][1])]
    records, nodes = linkage.cluster_records(spark.createDataFrame([(*r, "x") for r in rows], "complaint_id long, t string, cluster string"), "complaint_id", "t")
    got = {r.complaint_id: r.cluster for r in records.collect()}
    assert 1000 not in got and got[1001] is None and got[1002] == got[0]
    names_of = {t: {got[i] for i, v in truth.items() if v == t} for t in [*themes, None]}
    assert names_of[None] == {None} and all(len(names_of[t]) == 1 for t in themes) and len(set.union(*names_of.values())) == 4
    told = linkage.describe(records, nodes, "complaint_id").collect()
    assert len(told) == 3 and all(len(r.typical) == 5 for r in told)
    assert linkage.cluster_records(spark.createDataFrame([], "complaint_id long, t string"), "complaint_id", "t")[0].count() == 0


def test_one_shared_sentence_makes_no_copy(spark):
    rng = random.Random(9)
    themes = {t: [f"{w} {t} {k} thing happened to my {t} account." for k, w in enumerate(["The", "My", "Their", "Some", "No", "Every", "Any", "Each"])] for t in ("escrow", "parcel", "ticket", "refund", "notice")}
    aside = " We work three days a week and burn a whole tank of gas a month on the way to that office."
    rows = []
    for i in range(600):
        s = rng.sample(themes[list(themes)[i % 5]], 4) + [" ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(30)).capitalize() + "."]
        rows.append((i, " ".join(s) + aside))
    rows += [(1000, rows[0][1]), (1001, rows[1][1].replace("office", "offices"))]
    records, nodes = linkage.cluster_records(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    got = {r.id: r.cluster for r in records.collect()}
    of = [{got[i] for i in range(k, 600, 5)} - {None} for k in range(5)]
    assert all(len(x) == 1 for x in of) and len(set.union(*of)) == 5
    holds = [sum(r.node.split()[0].capitalize() + " " + r.node.split()[1] in t for i, t in rows if i < 1000) for r in nodes.collect()]
    assert sorted(holds) == sorted(r.n for r in nodes.collect())  # every record counts, the equal and the edited copy don't


def test_packing_is_exact(spark):
    rows = [(i, "word " * (i % 97 + 1)) for i in range(400)] + [(900, "long " * 1500), (901, None), (902, ""), (None, "no key"), (5, "word " * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k string")
    got = packing.pack(df, "doc_id", "text", capacity=128, share=150).collect()
    enc = packing.encoder(packing.tokenizer_path())
    sizes = sorted((k if k is not None else -1, len(enc.encode_ordinary(t))) for k, t in rows if t)
    by_doc, boxes = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id if r.doc_id is not None else -1, []).append(r)
        boxes.setdefault(r.container_id, []).append((r.container_offset, r.n_tokens))
    assert sum(r.n_tokens for r in got) == sum(n for _, n in sizes) and set(by_doc) == {k for k, _ in sizes}
    for spans in boxes.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 128
    long = sorted(by_doc[900], key=lambda r: r.piece)
    assert all(r.n_tokens == 128 for r in long[:-1]) and [r.token_start for r in long] == [128 * i for i in range(len(long))]
    assert sorted(map(tuple, packing.pack(df, "doc_id", "text", capacity=128, share=150).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_sum_of_squares_choice():
    def slow(counts, size, c):
        best = None
        for h in range(0, c - size + 1):
            if h and not counts[h]:
                continue
            n = dict(counts)
            if h:
                n[h] -= 1
            if h + size < c:
                n[h + size] = n.get(h + size, 0) + 1
            score = (sum(v * v for v in n.values()), -h)
            best = min(best, (score, h)) if best else (score, h)
        return best[1]

    rng = random.Random(4)
    p, counts = packing.SumOfSquares(16), {h: 0 for h in range(16)}
    for _ in range(400):
        size = rng.randint(1, 16)
        want = slow(counts, size, 16)
        _, level = p.place(size)
        assert level == want
        if level:
            counts[level] -= 1
        if level + size < 16:
            counts[level + size] += 1
    with pytest.raises(ValueError):
        p.place(17)


def test_kernel_folds_into_weights():
    rng = np.random.default_rng(1)
    w = rng.normal(size=1 << 18).astype(np.float32)
    items = ["you stupid idiot", "a", "", "plain words here, nothing else"]
    r, u, x, s = abuse.subsequences(items)
    direct = np.bincount(r, x * w[u], minlength=len(items)) * s  # no item holds the gap
    assert abuse._passage_scores(abuse.Model(w, 0.0, 0.0), items) == pytest.approx(direct, abs=1e-4)


def test_abuse_scores_held_out(spark):
    rng = random.Random(6)
    fine = ["the agent said a reply within {} days", "we went to the {} market on a sunny day", "this is a damn mess over {} dollars", "please review the {} matter soon", "the caller used strong language {} times"]
    foul = ["you stupid {} moron, drop dead", "go to hell you lazy {} bastard", "those people are {} vermin", "shut your mouth you filthy {} rat"]
    def doc(bad):
        s = [rng.choice(fine).format(rng.choice("red green blue 7 19".split())) for _ in range(6)]
        if bad:
            f = rng.choice(foul).format(rng.choice("red green blue 7 19".split()))
            s.insert(3, f.replace("moron", rng.choice(["moron", "m-o-r-o-n", "m0ron", "mooron"])))
        return ". ".join(x[0].upper() + x[1:] for x in s) + "."
    labels = [int(rng.random() < 0.3) for _ in range(400)]
    texts = [doc(v) for v in labels]
    model = abuse.fit(texts[:250], labels[:250], landmarks=96)
    hit = model.scores(texts[250:]) > model.threshold
    truth = np.array(labels[250:]) == 1
    assert (hit == truth).mean() > 0.95
    rows = [(i, t, "s1" if i % 2 else None, "z") for i, t in enumerate(texts[250:])] + [(900, None, "s1", "z"), (901, "", "s1", "z"), (902, "fine " * 60_000, "s1", "z")]
    scored = abuse.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, __y string"), "doc_id", "text", model, keep=("source",))
    got = {r.doc_id: (r.score, r.abusive) for r in scored.collect()}
    assert got[900] == (-9.0, False) and got[901] == (-9.0, False) and len(got) == len(rows)
    assert {r.source for r in abuse.source_rates(scored, "source").collect()} == {None, "s1"}
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert abuse.fit_labelled(empty.drop("toxic"), "doc_id", "text", empty.select("doc_id", "toxic"), "toxic").threshold == 0.0


def test_texts_are_read_to_their_end(spark):
    """Records without sentence ends or in capitals lie in the theme that their later words tell, whatever they begin with."""
    rng = random.Random(11)
    themes = {t: [f"{w} {t} {k} thing happened to my {t} account." for k, w in enumerate(["The", "My", "Their", "Some", "No", "Every", "Any", "Each"])] for t in ("escrow", "parcel", "ticket")}
    own = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(30)).capitalize() + "."
    rows = [(i, " ".join([own(), *rng.sample(themes[list(themes)[i % 3]], 4)])) for i in range(900)]
    plain = [(1000 + i, " ".join([own(), *rng.sample(themes[list(themes)[i % 3]], 4)]).replace(".", "")) for i in range(9)]
    plain += [(2000 + i, " ".join([own(), *rng.sample(themes[list(themes)[i % 3]], 4)]).upper()) for i in range(9)]
    records, _ = linkage.cluster_records(spark.createDataFrame(rows + plain, "id long, t string"), "id", "t")
    got = {r.id: r for r in records.collect()}
    of = [{got[i].cluster for i in range(k, 900, 3)} for k in range(3)]
    assert all(len(x) == 1 for x in of) and len(set.union(*of)) == 3 and None not in set.union(*of)
    for i, _ in plain:
        assert {got[i].cluster} == of[i % 1000 % 3] and got[i].weight > 0, i

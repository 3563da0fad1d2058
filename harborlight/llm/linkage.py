"""Clusters of records by average linkage, merging all reciprocal nearest neighbours of a sparse graph in each round.

Similarity of records. Texts of one theme share few words that a stranger wouldn't use as well; what tells a theme is which sentences keep
each other's company. A record is the set of its sentence openings (its first words, with companies and numbers masked). Two openings
are associated, by their normalised pointwise mutual information, if they meet in the same record so much more often than by chance
that not one of all pairs of openings would be expected to (a Poisson tail under a bound that is divided by the number of pairs). The similarity of
two records is the mean association of their openings, an opening with itself counting 1; openings that keep no company say nothing.

Linkage. Records led by the same opening (the one most associated with the record's others) are reciprocal nearest neighbours of each
other, so they start as one node. The similarity is bilinear, so the mean over all pairs of records of two nodes follows
exactly from their summed opening vectors: that is the sparse graph, and no pair of records is ever written. Average
linkage merges every mutual best pair of a round at once, which gives the same tree as one merge at a time, and stops
below MIN_SIMILARITY.

Clusters divide the records, so one whose records mostly hold openings of another cluster as well is a trait of records (a letterhead, a
habit of the pen) and is dissolved. Each record then lies in the cluster of the greatest mean similarity to its members. For that it is read word by
word to its end: an associated opening counts wherever its words stand, but for the usual length of another's sentence, so sentences that are run
together, in capitals or without an end count as others do. Clusters are learnt from sentence openings only, as words of one sentence keep each other's company by being that sentence.
Records in which nothing is associated (reworded, mistyped) are placed by word weights learnt from the others, or belong to none.

Copies would keep each other's company by being copies: near-duplicates count once, as their smallest id. No threshold depends on the size of the table but the
significance bound, which gets stricter with the number of pairs tested.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm import neardup
from harborlight.llm.consistent import consistent
from harborlight.session import cut, drop_cut

#: Records an opening must be in; least lift of an association; expected number of chance associations among all pairs; least average similarity of a merge.
SUPPORT, LIFT, CHANCE, MIN_SIMILARITY = 5, 1.2, 1e-4, 0.05
#: Words of an opening; openings of a record that far apart are met together, so a record of any length costs a multiple of its length.
OPENING, REACH = 4, 40
#: A record without an associated opening is placed if its word weights reach this much, and this much more than for any other cluster; a word weighs from this lift and this many records on.
LEAST_WEIGHT, LEAST_LEAD, WORD_LIFT, WORD_SUPPORT = 12.0, 1.4, 2.0, 3
#: A cluster is a theme if at least this share of the records that hold one of its openings hold none of another cluster.
LEAST_ALONE = 0.5
#: A graph of at most so many edges is linked in one task, by the same rule and with the same result; a larger one by joins, a round at a time.
LOCAL_EDGES = 200_000

COMPANY = re.compile(
    r"(?:\b[A-Z][\w&'-]*,?\s+){1,5}(?:Inc|LLC|Corp|Company|Co|N\.A|INC|CORP|COMPANY|CO)\b\.?(?:\.|(?=\s|$))|\bXXXX XXXX\b|\b[Tt]his company\b"
    r"|\b[Tt]he (?:company|firm|bank|bureau|agency|servicer|lender|issuer|collector)\b|\b[Tt]hey\b"
)
_TITLE = re.compile(r"\b(Mr|Mrs|Ms|Dr)\.\s")
_SENTENCE = re.compile(r"(?<=[a-z0-9)\]”’'\"][.!?])[.!?]*\s+|\n+| - (?=[A-Z])")
_WORD = re.compile(r"[a-z@]+(?:['’-][a-z]+)*|#")
_NUMBER = re.compile(r"\$?\d[\d,./]*")


def _sentences(form: str) -> list[list[str]]:
    """The words of each sentence of a text in its consistent form, companies as @ and numbers as #."""
    form = COMPANY.sub("@", _TITLE.sub(r"\1 ", form))
    return [_WORD.findall(_NUMBER.sub("#", s.lower())) for s in _SENTENCE.split(form)]


def openings(form: str) -> list[str]:
    """The different openings of the sentences of a text in its consistent form, in order."""
    return list(dict.fromkeys(" ".join(w[:OPENING]) for w in _sentences(form) if len(w) >= OPENING))


def runs(form: str) -> list[list[str]]:
    """For each sentence of a text in its consistent form all runs of OPENING words; the first is the opening."""
    return [[" ".join(w[i : i + OPENING]) for i in range(len(w) - OPENING + 1)] for w in _sentences(form) if len(w) >= OPENING]


def _read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        forms = [consistent(t) for t in pdf["t"]]
        words = [sorted({w for w in _WORD.findall(t.lower()) if len(w) > 2}) for t in forms]
        yield pd.DataFrame({"id": pdf["id"], "keys": [openings(t) for t in forms], "runs": [runs(t) for t in forms], "words": words})


def _link(edges: list[tuple[str, str, float]], sizes: dict[str, int], least: float) -> dict[str, str]:
    """Average linkage of a small graph: node -> smallest node of its cluster. Rounds of all mutual best pairs, as in the joins."""
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, total in edges:
        near[a][b] = near[b][a] = total
    size, members = dict(sizes), {n: [n] for n in sizes}
    todo = set(near)
    best: dict[str, str] = {}
    while todo:
        for a in todo:
            means = [(-round(t / (size[a] * size[b]), 12), b) for b, t in near[a].items() if round(t / (size[a] * size[b]), 12) >= least]
            if means:
                best[a] = min(means)[1]
            else:
                best.pop(a, None)
        merges = [(a, b) for a, b in best.items() if a < b and best.get(b) == a]
        todo = set()
        for a, b in merges:
            for x, t in near.pop(b).items():
                near[x].pop(b)
                if x != a:
                    near[a][x] = near[x][a] = near[a].get(x, 0.0) + t
            size[a] += size.pop(b)
            members[a] += members.pop(b)
            best.pop(b)
            todo.add(a)
        for a, _ in merges:  # a merge changes what its neighbours see
            todo.update(near[a])
    return {n: c for c, each in members.items() for n in each}


def reciprocal_linkage(edges: DataFrame, nodes: DataFrame, least: float, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, cluster) for all nodes (node, n): average linkage, down to the least average. edges are (a < b, total), the sum over all pairs of members.

    An absent edge is similarity 0. Means are compared to 12 places and ties go to the smaller name; a cluster bears its smallest node's name. Rounds of
    all mutual best pairs run as joins until at most `local` edges are left, which one task finishes; the result doesn't depend on when.
    """
    names = cut(nodes.select("node", F.col("node").alias("cluster"), F.col("n").cast("long").alias("n")))
    size = names.select(F.col("node").alias("c"), "n")
    ends = lambda s, name: s.select(F.col("c").alias(name), F.col("n").alias(f"n{name}"))
    sums = cut(edges.select("a", "b", F.col("total").cast("double").alias("total")).join(ends(size, "a"), "a").join(ends(size, "b"), "b"))
    while sums.limit(local + 1).count() > local:
        both = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "total", F.col("nb").alias("na"), F.col("na").alias("nb")))
        near = both.withColumn("mean", F.round(F.col("total") / (F.col("na") * F.col("nb")), 12)).where(F.col("mean") >= least)
        best = near.groupBy("a").agg(F.min_by("b", F.struct(-F.col("mean"), "b")).alias("b"))
        back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merges = cut(best.join(back, ["a", "b"]).where("a < b").select(F.col("b").alias("old"), F.col("a").alias("new")))
        if not merges.limit(1).count():
            drop_cut(sums, merges)
            return names.select("node", "cluster")
        ma, mb = merges.select(F.col("old").alias("a"), F.col("new").alias("xa")), merges.select(F.col("old").alias("b"), F.col("new").alias("xb"))
        moved = sums.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("xa", "a").alias("x"), F.coalesce("xb", "b").alias("y"), "total").where("x <> y")
        merged = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("total").alias("total"))
        renamed = cut(names.join(merges.withColumnRenamed("old", "cluster"), "cluster", "left").select("node", F.coalesce("new", "cluster").alias("cluster"), "n"))
        counts = renamed.groupBy(F.col("cluster").alias("c")).agg(F.sum("n").alias("n"))
        old_sums, old_names = sums, names
        sums, names = cut(merged.join(ends(counts, "a"), "a").join(ends(counts, "b"), "b")), renamed
        drop_cut(old_sums, old_names, merges)

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(it) or [pd.DataFrame(columns=["a", "b", "total", "na", "nb"])])
        sizes = dict(zip(rows["a"], rows["na"])) | dict(zip(rows["b"], rows["nb"]))
        got = _link(list(zip(rows["a"], rows["b"], rows["total"])), sizes, least)
        yield pd.DataFrame({"cluster": list(got), "top": list(got.values())}, dtype=object)

    last = sums.coalesce(1).mapInPandas(finish, "cluster string, top string")
    out = cut(names.join(last, "cluster", "left").select("node", F.coalesce("top", "cluster").alias("cluster")))
    drop_cut(sums, names)
    return out


def copied(base: DataFrame) -> DataFrame:
    """The ids of base (id, t) that are equal or near-duplicate to a smaller id: statistics count a class of copies once."""
    members, links = neardup.near_duplicates(base, "id", "t")
    # an edited text's own copies are copies already, as members of its group
    return members.where("id <> rep").select("id").unionByName(links.select(F.col("rep_b").alias("id"))).distinct()


def _pairs(held: DataFrame) -> DataFrame:
    """held (id, keys) -> (id, f, g) for each two openings of a record that are at most REACH openings apart, f < g."""
    each = held.select("id", F.posexplode("keys").alias("i", "x"), "keys").select("id", "x", F.explode(F.slice("keys", F.col("i") + 2, REACH)).alias("y"))
    return each.select("id", F.least("x", "y").alias("f"), F.greatest("x", "y").alias("g"))


def _kept(read: DataFrame, keep: DataFrame) -> DataFrame:
    """read (id, keys) with only the openings of keep (key), in order."""
    each = read.select("id", F.posexplode("keys").alias("i", "key")).join(keep, "key")
    return each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "key"))), lambda s: s["key"]).alias("keys"))


def _anywhere(read: DataFrame, copies: DataFrame, bearing: DataFrame) -> DataFrame:
    """read (id, runs) -> (id, keys) where there are any: the openings of bearing (key) met anywhere in a record, in order. A run is its hash.

    An opening's own sentence is as long as half of the sentences that begin with it; what is met within that length isn't another sentence's opening.
    """
    sentences = read.join(copies, "id", "left_anti").select(F.explode("runs").alias("s")).select(F.col("s")[0].alias("run"), F.size("s").alias("n"))
    own = bearing.select(F.xxhash64("key").alias("run"), "key")
    known = cut(own.join(sentences, "run").groupBy("run", "key").agg(F.percentile_approx("n", 0.5, 1000).alias("n")))
    each = read.select("id", F.posexplode("runs").alias("s", "in_s")).select("id", "s", F.posexplode("in_s").alias("i", "run")).join(known, "run")
    place = F.sort_array(F.collect_list(F.struct("s", "i", "n", "key")))
    none = F.struct(F.lit(-1).alias("s"), F.lit(0).alias("end"), F.array().cast("array<string>").alias("keys"))
    more = lambda s, x: F.struct(x["s"].alias("s"), (x["i"] + F.greatest(x["n"] + OPENING - 1, F.lit(OPENING))).alias("end"), F.concat(s["keys"], F.array(x["key"])).alias("keys"))
    take = lambda s, x: F.when((x["s"] != s["s"]) | (x["i"] >= s["end"]), more(s, x)).otherwise(s)
    return each.groupBy("id").agg(F.aggregate(place, none, take, lambda s: F.array_distinct(s["keys"])).alias("keys"))


def associations(originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """originals (id, keys) -> (f < g, w) significantly associated openings with their normalised mutual information, and the support (key, n)."""
    n = originals.count()
    total = F.lit(float(max(1, n)))
    support = cut(originals.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT))
    m = support.count()
    # how unlikely one of m (m - 1) / 2 pairs may be so that CHANCE of them are expected
    bound = F.lit(CHANCE / max(1.0, m * (m - 1) / 2))
    met = _pairs(_kept(originals, support.select("key"))).groupBy("f", "g").agg(F.count(F.lit(1)).alias("k"))
    sf, sg = support.select(F.col("key").alias("f"), F.col("n").alias("nf")), support.select(F.col("key").alias("g"), F.col("n").alias("ng"))
    e, k = F.col("nf") * F.col("ng") / total, F.col("k")
    scored = met.where("k > 1").join(sf, "f").join(sg, "g").withColumn("e", e)
    # the Chernoff bound of a Poisson tail
    unlikely = (k - F.col("e") - k * F.log(k / F.col("e"))) <= F.log(bound)
    edges = scored.where((k >= LIFT * F.col("e")) & unlikely & (k < total)).select("f", "g", F.round(F.log(k / F.col("e")) / -F.log(k / total), 9).alias("w"))
    return cut(edges), support


def cluster_records(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """records (key, cluster, weight) for each row with a text, cluster null for none; and openings (node, cluster, n).

    weight is a record's mean similarity to the members of its cluster, or 0 for one placed by its words. Null texts are left out; repeated keys with the
    same text count once. Few or short texts may have no cluster at all; records of a theme met fewer than SUPPORT times have none.
    """
    base = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).distinct()
    parsed = base.mapInPandas(_read, "id long, keys array<string>, runs array<array<string>>, words array<string>")
    read = cut(parsed.withColumn("runs", F.transform("runs", lambda s: F.transform(s, lambda x: F.xxhash64(x)))))
    copies = cut(copied(base))
    edges, support = associations(read.select("id", "keys").join(copies, "id", "left_anti"))
    both = edges.unionByName(edges.select(F.col("g").alias("f"), F.col("f").alias("g"), "w"))
    bearing = both.select(F.col("f").alias("key")).distinct()
    assoc = cut(both.unionByName(bearing.select(F.col("key").alias("f"), F.col("key").alias("g"), F.lit(1.0).alias("w"))))
    held = cut(_kept(read, bearing))
    # record vectors: each bearing opening of a record has an equal share
    vector = held.select("id", F.explode("keys").alias("f"), (1 / F.size("keys")).alias("u"))
    inside = _pairs(held).join(edges, ["f", "g"])
    company = inside.select("id", "f", "w").unionByName(inside.select("id", F.col("g").alias("f"), "w")).groupBy("id", "f").agg(F.round(F.sum("w"), 9).alias("c"))
    vector = cut(vector.join(company, ["id", "f"], "left").join(support.select(F.col("key").alias("f"), "n"), "f").select("id", "f", "u", F.coalesce("c", F.lit(0.0)).alias("c"), "n"))
    lead = vector.join(copies, "id", "left_anti").groupBy("id").agg(F.max_by("f", F.struct("c", "n", "f")).alias("node"))
    summed = cut(vector.join(lead, "id").groupBy("node", "f").agg(F.sum("u").alias("u")))
    sizes = lead.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    # mean similarities of nodes from their summed vectors: U A U'
    spread = summed.join(assoc, "f").groupBy("node", "g").agg(F.sum(F.col("u") * F.col("w")).alias("v"))
    a, b = spread.select(F.col("node").alias("a"), F.col("g").alias("f"), "v"), summed.select(F.col("node").alias("b"), "f", "u")
    graph = a.join(b, "f").where("a < b").groupBy("a", "b").agg(F.sum(F.col("v") * F.col("u")).alias("total"))
    tree = reciprocal_linkage(graph, sizes, MIN_SIMILARITY)
    # clusters as vectors of openings; an opening is its cluster's in which it has most weight
    whole = cut(summed.join(tree, "node").groupBy("cluster", "f").agg(F.sum("u").alias("u")))
    owner = whole.groupBy("f").agg(F.max_by("cluster", F.struct(F.round("u", 9), "cluster")).alias("cluster"))
    touched = held.select("id", F.explode("keys").alias("f")).join(owner, "f").select("id", "cluster").distinct()
    several = touched.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    themes = cut(touched.join(several, "id").groupBy("cluster").agg(F.avg((F.col("c") == 1).cast("double")).alias("share")).where(F.col("share") >= LEAST_ALONE).select("cluster"))
    members = sizes.join(tree, "node").groupBy("cluster").agg(F.sum("n").alias("size"))
    # similarities of records to clusters, both by all they hold
    full = cut(_anywhere(read, copies, bearing).select("id", F.explode("keys").alias("f"), (1 / F.size("keys")).alias("u")))
    held_by = full.join(lead, "id").join(tree, "node").groupBy("cluster", "f").agg(F.sum("u").alias("u"))
    mean = held_by.join(themes, "cluster").join(members, "cluster").join(assoc, "f").groupBy("cluster", F.col("g").alias("f")).agg((F.sum(F.col("u") * F.col("w") / F.col("size"))).alias("v"))
    close = full.join(mean, "f").groupBy("id", "cluster").agg(F.round(F.sum(F.col("u") * F.col("v")), 9).alias("weight"))
    best = close.groupBy("id").agg(F.max_by(F.struct("cluster", "weight"), F.struct("weight", "cluster")).alias("b"))
    linked = cut(best.where(F.col("b.weight") >= MIN_SIMILARITY).select("id", "b.cluster", "b.weight"))
    placed = _by_words(read, linked)
    records = read.select("id").join(linked.unionByName(placed), "id", "left").withColumnRenamed("id", key)
    nodes = owner.join(themes, "cluster").join(support.withColumnRenamed("key", "f"), "f").select(F.col("f").alias("node"), "cluster", "n")
    records, nodes = cut(records), cut(nodes)
    drop_cut(read, copies, edges, support, assoc, held, vector, summed, tree, whole, full, themes, linked)
    return records, nodes


def _by_words(read: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, cluster, weight 0) for records (id, words) that aren't linked but whose words tell the cluster: how much more often a word is met in it than anywhere."""
    labelled = read.select("id", "words").join(linked.select("id", "cluster"), "id", "left").select("cluster", F.explode("words").alias("word"))
    by = labelled.groupBy("word", "cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = linked.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    total = by.groupBy("word").agg(F.sum("n").alias("wn"))
    records = F.lit(float(max(1, read.count())))
    lift = (F.col("n") + 0.5) / (F.col("size") + 1) / (F.col("wn") / records)
    known = by.where("cluster is not null").where(F.col("n") >= WORD_SUPPORT).join(total, "word").join(sizes, "cluster").withColumn("lift", lift)
    weights = known.where(F.col("lift") >= WORD_LIFT).select("word", "cluster", F.log("lift").alias("w"))
    rest = read.select("id", "words").join(linked.select("id"), "id", "left_anti").select("id", F.explode("words").alias("word"))
    sums = rest.join(weights, "word").groupBy("id", "cluster").agg(F.sum("w").alias("w"))
    top = sums.groupBy("id").agg(F.max_by(F.struct("w", "cluster"), F.struct("w", "cluster")).alias("s"), F.sort_array(F.collect_list("w"), asc=False).alias("ws"))  # as many as clusters
    lead = F.col("s.w") >= LEAST_LEAD * F.coalesce(F.try_element_at("ws", F.lit(2)), F.lit(0.0))
    return top.where((F.col("s.w") >= LEAST_WEIGHT) & lead).select("id", "s.cluster", F.lit(0.0).alias("weight"))


def _first(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """(cluster, values): the k values of greatest `by` of each cluster, ties to the smaller value. The first k of each of 64 parts meet, so a cluster of any size is many tasks."""
    order = f"order by {by} desc, {value}"
    parts = rows.selectExpr("cluster", by, value, f"row_number() over (partition by cluster, pmod(xxhash64({value}), 64) {order}) as r").where(F.col("r") <= k)
    top = parts.selectExpr("cluster", value, f"row_number() over (partition by cluster {order}) as r").where(F.col("r") <= k)
    return top.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", value))), lambda s: s[value]).alias("values"))


def describe(records: DataFrame, nodes: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(cluster, size, typical, phrases): how many records, the k of greatest mean similarity to the others, the k most frequent openings."""
    held = records.where("cluster is not null")
    size = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    typical = _first(held, "weight", key, k).withColumnRenamed("values", "typical")
    return size.join(typical, "cluster").join(_first(nodes, "n", "node", k).withColumnRenamed("values", "phrases"), "cluster", "left")

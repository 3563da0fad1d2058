"""Exact and near-duplicate tiers, star clustering and campaign features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.session import cut, drop_cut

PERMUTATIONS, BANDS, ROWS, PRIME, THRESHOLD, SEED = 128, 16, 8, (1 << 32) - 5, 0.88, 20260803


def exact_pairs(texts: DataFrame) -> DataFrame:
    """texts (id, h): each copy linked to the smallest id of its hash, similarity 1; n - 1 links for n copies."""
    first = texts.groupBy("h").agg(F.min("id").alias("a"))
    return texts.join(first, "h").where("id > a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("method"))


def exact_representatives(texts: DataFrame) -> DataFrame:
    """texts (id, h, family, text): the smallest id of each hash."""
    return texts.groupBy("h").agg(F.min_by(F.struct("id", "family", "text"), "id").alias("r")).select("h", "r.id", "r.family", "r.text")


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, PRIME, PERMUTATIONS, dtype=np.uint64), rng.integers(0, PRIME, PERMUTATIONS, dtype=np.uint64)


_A, _B = _coefficients()


def signature(pieces: list[str]) -> np.ndarray:
    """The smallest (a h + b) mod p of the pieces' CRC-32 for each permutation; no pieces give 2^32 - 1."""
    if not pieces:
        return np.full(PERMUTATIONS, (1 << 32) - 1, np.uint64)
    h = np.array([zlib.crc32(p.encode()) for p in pieces], np.uint64)
    return ((_A[:, None] * (h % np.uint64(PRIME))[None, :] + _B[:, None]) % np.uint64(PRIME)).min(axis=1)


def _sign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rng = np.random.default_rng(0)
    mix = rng.integers(1, PRIME, ROWS, dtype=np.uint64)
    for pdf in it:
        sigs = [signature(sorted({t[i : i + 5] for i in range(len(t) - 4)} if len(t) > 5 else {t} if t else set())) for t in pdf["text"]]
        bands = [((s.reshape(BANDS, ROWS) * mix) % np.uint64(PRIME)).sum(axis=1).astype(np.int64) for s in sigs]
        yield pd.DataFrame({"id": pdf["id"], "family": pdf["family"], "sig": [s.astype(np.int64) for s in sigs], "bands": bands})


def minhash_links(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """reps (id, family, text): links a < b within a family whose signatures agree in at least the threshold.

    Candidates are all pairs in a band, met by an equi-join that AQE splits where a band is hot; none is capped away.
    """
    signed = cut(reps.select("id", "family", "text").mapInPandas(_sign, "id long, family string, sig array<long>, bands array<long>"))
    band = signed.select("id", "family", F.posexplode("bands").alias("band", "h"))
    a, b = band.select(F.col("id").alias("a"), "family", "band", "h"), band.select(F.col("id").alias("b"), "family", "band", "h")
    on = a["family"].eqNullSafe(b["family"]) & (a["band"] == b["band"]) & (a["h"] == b["h"]) & (F.col("a") < F.col("b"))
    pairs = a.join(b, on).select("a", "b").distinct()
    sa, sb = signed.select(F.col("id").alias("a"), F.col("sig").alias("sa")), signed.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    scored = pairs.join(sa, "a").join(sb, "b").withColumn("similarity", same / PERMUTATIONS)
    return scored.where(F.col("similarity") >= threshold).select("a", "b", "similarity", F.lit("minhash").alias("method"))


#: Undecided nodes and links that one task decides by the sequential rule, with the same result as more rounds would have.
LOCAL_LINKS = 200_000


def _greedy(nodes: list[tuple[int, int, bool]], links: list[tuple[int, int]]) -> list[tuple[int, bool]]:
    """(id, is_seed) of undecided nodes (id, degree, taken): in order of degree and id, a node that is not taken yet is a seed and takes its neighbours."""
    near: dict[int, list[int]] = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
    taken = {i for i, _, t in nodes if t}
    out = []
    for i, _, _ in sorted(nodes, key=lambda x: (-x[1], x[0])):
        seed = i not in taken
        out.append((i, seed))
        if seed:
            taken.update(near.get(i, ()))
    return out


def star_clusters(nodes: DataFrame, links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(id, seed): seeds in order of degree (then id) take their unassigned neighbours; nobody chains on through a member.

    Rounds: an undecided node that comes before all its undecided neighbours is a seed, and its neighbours are members. The seeds are
    those of the sequential greedy. Once at most `local` links between undecided nodes are left, one task decides the rest by that greedy itself, so a long chain of
    equal degrees doesn't take a round a node. A member then takes the first of its seed neighbours in that order. Nodes without a link are seeds; ends that are no nodes are ignored.
    """
    ids = nodes.select("id").distinct()
    real = links.where("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    both = cut(real.select("a", "b").unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    state = cut(ids.join(degree.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"), F.when(F.col("deg").isNull(), 1).otherwise(0).alias("is_seed"), F.col("deg").isNotNull().cast("int").alias("open")))
    live = both
    while live.limit(local + 1).count() > local:
        free = state.where("open = 1").select("id", F.struct(-F.col("deg"), "id").alias("rank"))
        other = free.select(F.col("id").alias("b"), F.col("rank").alias("brank"))
        rival = live.join(other, "b").groupBy("a").agg(F.min("brank").alias("first"))
        seeds = cut(free.join(rival, free.id == rival.a, "left").where("first is null or rank < first").select("id"))
        taken = live.join(seeds.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id")).distinct().withColumn("t", F.lit(1))
        nxt = state.join(seeds.withColumn("s", F.lit(1)), "id", "left").join(taken, "id", "left")
        new = cut(nxt.select("id", "deg", F.when((F.col("open") == 1) & F.col("s").isNotNull(), 1).otherwise(F.col("is_seed")).alias("is_seed"), F.when(F.col("s").isNotNull() | F.col("t").isNotNull(), 0).otherwise(F.col("open")).alias("open")))
        still = new.where("open = 1").select("id")
        rest = cut(live.join(still.withColumnRenamed("id", "a"), "a", "left_semi").join(still.withColumnRenamed("id", "b"), "b", "left_semi"))
        drop_cut(state, seeds, *([live] if live is not both else []))
        state, live = new, rest

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(it) or [pd.DataFrame(columns=["id", "deg", "b"])])
        known = rows.drop_duplicates("id")
        got = _greedy([(int(i), int(d), False) for i, d in zip(known["id"], known["deg"])], [(int(a), int(b)) for a, b in zip(rows["id"], rows["b"]) if b == b and b is not None])
        yield pd.DataFrame({"id": [i for i, _ in got], "s": [s for _, s in got]}).astype({"id": "int64", "s": bool})

    open_ = state.where("open = 1").select("id", "deg").join(live.withColumnRenamed("a", "id"), "id")
    alone = state.where("open = 1").join(live.select(F.col("a").alias("id")), "id", "left_anti").select("id", F.lit(True).alias("s"))  # all rivals are decided
    decided = open_.coalesce(1).mapInPandas(finish, "id long, s boolean").unionByName(alone)
    state = cut(state.join(decided, "id", "left").select("id", "deg", F.when(F.coalesce("s", F.lit(False)), 1).otherwise(F.col("is_seed")).alias("is_seed")))
    seeds = state.where("is_seed = 1")
    near = both.join(seeds.select(F.col("id").alias("b"), "deg"), "b").groupBy("a").agg(F.min_by("b", F.struct(-F.col("deg"), "b")).alias("seed"))
    return state.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.when(F.col("is_seed") == 1, F.col("id")).otherwise(F.col("seed")).alias("seed"))


def group_representative(members: DataFrame, group: str, order: list[str]) -> DataFrame:
    """members plus is_representative: the first of its group by the order, which should be total. One aggregate a group and a join, so a group of any size is many tasks."""
    first = members.groupBy(F.col(group).alias("__g")).agg(F.min(F.struct(*order)).alias("__m"))
    return members.join(first, F.col(group).eqNullSafe(F.col("__g"))).withColumn("is_representative", F.struct(*order).eqNullSafe(F.col("__m"))).drop("__g", "__m")


def concentration(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """(group, name): sum of squared shares of the values, null counted as a value."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(group).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias(name))


def campaign_features(members: DataFrame) -> DataFrame:
    """members (group_id, id, day, family, state, company, char_len, text) -> one row a group."""
    daily = members.groupBy("group_id", "day").agg(F.count(F.lit(1)).alias("n")).groupBy("group_id").agg((F.var_pop("n") / F.avg("n")).alias("burstiness"))
    base = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_complaints"),
        F.mode("family", True).alias("family"),
        (F.stddev_pop("char_len") / F.avg("char_len")).alias("length_cv"),
        F.avg(F.coalesce(F.col("text").rlike(T.BOILERPLATE), F.lit(False)).cast("double")).alias("boilerplate"),
    )
    return base.join(daily, "group_id").join(concentration(members, "group_id", "state", "state_hhi"), "group_id").join(concentration(members, "group_id", "company", "company_hhi"), "group_id")


def campaign_flags(features: DataFrame, baseline: DataFrame, min_size: int = 20, min_signals: int = 3) -> DataFrame:
    """features joined to the family's (base_state, base_company): the five signals, their number, and the flag (size first)."""
    j = features.join(baseline, "family", "left")
    expected = lambda h: F.col(h) + (1 - F.col(h)) / F.col("n_complaints")
    signals = [
        F.col("burstiness") > 3.0, F.col("state_hhi") > 1.5 * expected("base_state"), F.col("company_hhi") > 1.5 * expected("base_company"),
        F.coalesce("length_cv", F.lit(1.0)) < 0.20, F.col("boilerplate") > 0.50,
    ]
    total = sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0))
    return j.withColumn("n_signals", total).withColumn("flagged", (F.col("n_complaints") >= min_size) & (F.col("n_signals") >= min_signals))

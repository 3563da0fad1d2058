"""Near-duplicate texts by ProbMinHash signatures, banding and exact verification.

Each weighted shingle of a text sends arrivals of a Poisson process of its weight's rate, seeded by the shingle alone; each
arrival hits one random register, and a register keeps its earliest arrival. Two texts agree in a register with
the probability Jaccard similarity of their weighted shingles (for equal weights: their Jaccard similarity). Arrivals later than the
latest register can't change anything, so a shingle stops there; this early termination makes the
signature cost about n + m log m instead of n * m. The arrivals of all shingles of many texts are drawn together, round by round.

Weights are 1 (the similarity is that of sets) or a shingle's number of occurrences (probability Jaccard of the counts).

Plan: fold text -> one row per distinct folded text (exact copies never meet in a band) -> signatures and a 128-byte
count of shingles by hash -> one 64-bit key per band -> self-join on the key (AQE splits hot keys) -> distinct candidate
pairs -> length bound in the JVM -> upper bound from the counts, so that only pairs that may be similar get whole texts
(pairs of strangers that meet by chance grow with the square of the corpus) -> exact similarity on whole texts -> copies joined back.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.consistent import folded

#: 40 bands of 7 registers: a pair at similarity 0.80 is missed with probability 8e-5, at 0.85 with 1e-7.
BANDS, ROWS, SHINGLE, THRESHOLD, SEED = 40, 7, 5, 0.80, 20260803
_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def char_shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the k-character pieces in order; a shorter text is one piece, an empty one has none."""
    if not text:
        return np.empty(0, np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) <= k:
        k = len(c)
    n = len(c) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + c[i : i + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= _M1
    return mix64(h)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, m: int, seed: int = SEED) -> np.ndarray:
    """ProbMinHash signatures (docs x m, uint64) of weighted elements; owner says whose each element is.

    A register holds its earliest arrival time (32 bits, sort order of float32) and the element's low 32 bits. A text
    without elements keeps the largest value in all registers.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(docs * m, none, np.uint64)
    state = mix64(elements ^ np.uint64(seed))
    low = elements & np.uint64(0xFFFFFFFF)
    t = np.zeros(len(elements))
    w, own, base = weights.astype(np.float64), owner.astype(np.int64), owner.astype(np.int64) * m
    while len(state):
        state = state + _G
        r = mix64(state)
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        t = t - np.log(u) / w
        reg = (mix64(r ^ _G) % np.uint64(m)).astype(np.int64)
        packed = (t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
        np.minimum.at(sig, base + reg, packed)
        worst = sig.reshape(docs, m).max(axis=1)
        alive = packed < worst[own]
        state, t, w, low, own, base = state[alive], t[alive], w[alive], low[alive], own[alive], base[alive]
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band: a hash of the band's number and the elements in its registers."""
    docs = len(sig)
    part = (sig & np.uint64(0xFFFFFFFF)).reshape(docs, bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, (docs, bands)).copy()
    for i in range(rows):
        h = mix64(h ^ (part[:, :, i] + mix64(np.array([i + 1], np.uint64))))
    return h.view(np.int64)


#: Buckets of the shingle counts, a byte each.
BUCKETS = 128


def _sketch(hashes: np.ndarray) -> bytes:
    """How many of the distinct shingles fall in each bucket; 255 stands for that many or more."""
    return np.minimum(np.bincount((hashes >> np.uint64(32)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _sign(bands: int, rows: int, k: int, counted: bool):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                both = [np.unique(char_shingles(t, k), return_counts=True) for t in part["folded"]]
                sets = [h for h, _ in both]
                sizes = np.array([len(s) for s in sets], np.int64)
                elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
                weights = np.concatenate([n for _, n in both]).astype(float) if counted else np.ones(len(elements))
                owner = np.repeat(np.arange(len(sets)), sizes)
                sig = signatures(elements, weights, owner, len(sets), bands * rows)
                keys = band_keys(sig, bands, rows)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "n_pieces": sizes.astype(np.int32), "sketch": [_sketch(x) for x in sets], "keys": list(keys)})

    return run


def _may_reach(threshold: float):
    """Keeps the pairs whose counts allow the threshold: shared shingles are at most the smaller count of each bucket.

    A bucket at 255 may hold any number, so it counts as all of the smaller text's shingles.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            a = np.frombuffer(b"".join(pdf["sketch_a"]), np.uint8).reshape(-1, BUCKETS)
            b = np.frombuffer(b"".join(pdf["sketch_b"]), np.uint8).reshape(-1, BUCKETS)
            na, nb = pdf["n_a"].to_numpy(np.int64), pdf["n_b"].to_numpy(np.int64)
            low = np.minimum(a, b)
            most = np.where((low == 255).any(axis=1), np.minimum(na, nb), low.sum(axis=1, dtype=np.int64))
            # shared / (na + nb - shared) >= threshold
            yield pdf.loc[most * (1 + threshold) >= threshold * (na + nb) - 1e-9, ["rep_a", "rep_b"]]

    return run


def probability_jaccard(x: dict, y: dict) -> float:
    """The share of equal minima of exponential arrivals at rates x and y: for equal rates |both| / |either|."""
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def _probability(a: Counter, b: Counter) -> float:
    """probability_jaccard of two counts, vectorised: pieces of equal counts in both texts share a term."""
    keys = list(a.keys() | b.keys())
    x, y = np.array([a[k] for k in keys], float), np.array([b[k] for k in keys], float)
    total, seen = 0.0, Counter(zip(x[(x > 0) & (y > 0)], y[(x > 0) & (y > 0)]))
    for (xi, yi), n in seen.items():
        total += n / np.maximum(x / xi, y / yi).sum()
    return float(total)


def _exact(k: int, threshold: float, counted: bool):
    def shape(text: str):
        return Counter([text[i : i + k] for i in range(len(text) - k + 1)] if len(text) > k else [text] if text else []) if counted else frozenset(pieces(text, k))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sa = None, None
        for pdf in it:
            out = []
            for a, b, ta, tb in pdf[["rep_a", "rep_b", "text_a", "text_b"]].itertuples(index=False):
                if a != last:  # rows of one text come together
                    last, sa = a, shape(ta)
                sb = shape(tb)
                both = 0 if counted else len(sa & sb)
                sim = _probability(sa, sb) if counted else both / (len(sa) + len(sb) - both)
                if sim >= threshold:
                    out.append((a, b, sim))
            yield pd.DataFrame(out, columns=["rep_a", "rep_b", "similarity"]).astype({"rep_a": "int64", "rep_b": "int64", "similarity": "float64"})

    return run


def pieces(text: str, k: int) -> set[str]:
    return {text[i : i + k] for i in range(len(text) - k + 1)} if len(text) > k else ({text} if text else set())


def _fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame({"id": pdf["id"], "folded": [folded(t) for t in pdf["text"]]})


def folded_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, folded). Null keys, null texts and texts that fold to nothing have no pieces, so they are in no pair and are left out."""
    base = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return base.mapInPandas(_fold, "id long, folded string").where("folded <> ''").select("id", F.sha2("folded", 256).alias("digest"), "folded")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE, cut=None, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Groups of exact copies and links between their representatives.

    Returns members (id, rep) with one row for each text, and links (rep_a < rep_b, similarity) for all
    pairs of different folded texts at or above the threshold that share a band. Texts shorter than k are one piece.
    counted weights each piece by its number of occurrences; similarity is then the probability Jaccard similarity.
    """
    from harborlight.session import cut as default_cut
    from harborlight.session import drop_cut

    cut = cut or default_cut
    texts = cut(folded_texts(df, key, text))
    # copies meet in partial aggregates; one row a digest on one side, so a group of copies of any size is split over tasks on the other
    first = texts.groupBy("digest").agg(F.min(F.struct("id", "folded")).alias("m"))
    distinct = cut(first.select("digest", F.col("m.id").alias("rep"), F.col("m.folded").alias("folded")))
    members = cut(texts.select("id", "digest").join(distinct.select("digest", "rep"), "digest").select("id", "rep").distinct())
    drop_cut(texts)
    signed = cut(distinct.mapInPandas(_sign(bands, rows, k, counted), "rep long, n_pieces int, sketch binary, keys array<long>"))
    band = signed.select("rep", "n_pieces", F.explode("keys").alias("key"))
    a, b = (band.select(F.col("rep").alias(f"rep_{s}"), F.col("n_pieces").alias(f"n_{s}"), "key") for s in "ab")
    pairs = a.join(b, "key").where("rep_a < rep_b")
    if not counted:
        # |A and B| <= min(|A|, |B|), so a pair whose sizes are further apart than the threshold can't reach it
        pairs = pairs.where(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
        pairs = pairs.select("rep_a", "rep_b").distinct()
        sa, sb = (signed.select(F.col("rep").alias(f"rep_{s}"), F.col("n_pieces").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
        near = pairs.join(sb, "rep_b").join(sa, "rep_a").mapInPandas(_may_reach(threshold), "rep_a long, rep_b long")
    else:
        near = pairs.select("rep_a", "rep_b").distinct()
    ta = distinct.select(F.col("rep").alias("rep_a"), F.col("folded").alias("text_a"))
    tb = distinct.select(F.col("rep").alias("rep_b"), F.col("folded").alias("text_b"))
    # written, so that its size is known: few pairs are sent to the texts, many meet them by shuffling
    both = cut(near).join(tb, "rep_b").join(ta, "rep_a")
    links = both.mapInPandas(_exact(k, threshold, counted), "rep_a long, rep_b long, similarity double")
    return members, links


def all_pairs(members: DataFrame, links: DataFrame, salts: int = 16) -> DataFrame:
    """(complaint_id_a < complaint_id_b): the links with their copies, and the pairs of copies.

    One side of each join is salted and the other repeated for each salt, so the copies of one text are many tasks. The output
    grows with the square of a group of copies; classes() has the same in one row a text.
    """
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    copied = members.groupBy("rep").count().where("count > 1").select("rep")
    within = members.join(copied, "rep", "left_semi")
    same = within.select(F.col("id").alias("id_a"), "rep", salt("id").alias("salt")).join(within.select(F.col("id").alias("id_b"), "rep", every), ["rep", "salt"])
    same = same.where("id_a < id_b").select("id_a", "id_b")
    ends = {s: members.select(F.col("id").alias(f"id_{s}"), F.col("rep").alias(f"rep_{s}")) for s in "ab"}
    across = links.join(ends["a"], "rep_a").join(ends["b"], "rep_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return across.unionByName(same).select(F.col("id_a").alias("complaint_id_a"), F.col("id_b").alias("complaint_id_b"))


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each text: (id, rep, n_copies, n_links), links counted between different texts."""
    ends = links.select(F.col("rep_a").alias("rep")).unionByName(links.select(F.col("rep_b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_copies"))
    return members.join(size, "rep").join(degree, "rep", "left").select("id", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))

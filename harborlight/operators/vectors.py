"""Unit vectors: exact nearest neighbours, centroids, assignment, novelty and agreement measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.session import cut, drop_cut

MAX_DISTANCE, RELATED, BLOCK_BYTES = 0.35, 0.80, 256 << 20


def dot(a, b):
    """Inner product in double precision, in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _blocks(rows: DataFrame, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys in order, vectors) of rows (key, vector), in blocks of about `most` bytes: a hash of the key tells the block, so blocks are collected one at a time."""
    key, v = rows.columns[:2]
    n, dim = rows.count(), len((rows.select(v).first() or [[]])[0])
    blocks = max(1, -(-8 * n * dim // (most or BLOCK_BYTES)))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else rows
        got = sorted((r[0], r[1]) for r in part.select(key, v).collect())
        yield np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64).reshape(len(got), dim)


def _in_turn(rows: DataFrame, run) -> DataFrame:
    """The union of run(keys, matrix) over all blocks of rows. With several of them each result is written before the next block is sent, so one is held at a time."""
    out, held = None, None
    context = rows.sparkSession.sparkContext
    for ids, matrix in _blocks(rows):
        if held is not None:  # there are more: write what the last block gave
            out[-1] = cut(out[-1])
            held.destroy()
        held = context.broadcast((ids, matrix))
        out = [*(out or []), run(held)]
    if len(out) > 1:
        out[-1] = cut(out[-1])
        held.destroy()
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def nearest(queries: DataFrame, base: DataFrame, k: int, same: bool = True) -> DataFrame:
    """(id, neighbour, score, rank): the k base vectors of highest inner product for each query vector; with `same` ids are of one table, and a row is never its own neighbour.

    Rows with a null id or vector are left out; no query rows give no rows. The stated queries (id, v) are sent to the tasks in blocks of bounded size, one at a time, and held
    against all base rows; each batch keeps its k best for each query, so k rows a query and batch are shuffled. Ties go to the smaller neighbour.
    """
    queries, base = (x.where("id is not null and v is not null").select("id", "v") for x in (queries, base))

    def against(held) -> DataFrame:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = held.value
            for pdf in it:
                if not len(pdf) or not len(ids):
                    continue
                other = pdf["id"].to_numpy()
                s = matrix @ np.array(pdf["v"].tolist(), np.float64).T
                if same:
                    s[ids[:, None] == other[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(other, s.shape), -s), axis=1)[:, :k]
                top = np.take_along_axis(s, order, 1)
                keep = np.isfinite(top)
                yield pd.DataFrame({"id": np.repeat(ids, order.shape[1])[keep.ravel()], "neighbour": other[order].ravel()[keep.ravel()], "score": top.ravel()[keep.ravel()]})

        return base.select("id", "v").mapInPandas(run, "id long, neighbour long, score double")

    out = _in_turn(queries, against)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(points: DataFrame) -> DataFrame:
    """points (id, v, cluster) -> (cluster, centroid, n): the mean vector scaled to length 1."""
    each = points.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = each.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    n = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return mean.withColumn("norm", norm).select("cluster", F.transform("mean", lambda x: x / F.col("norm")).alias("centroid")).join(n, "cluster")


def assign(points: DataFrame, centres: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(id, cluster, similarity): the nearest centroid (ties: the smaller cluster), cluster -1 beyond the distance. Without centroids similarity is null.

    The centroids are the stated query set, in blocks; a point's best of each block meet afterwards.
    """

    def against(held) -> DataFrame:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = held.value
            for pdf in it:
                if len(pdf):
                    if len(ids):
                        s = np.array(pdf["v"].tolist(), np.float64) @ matrix.T
                        at = s.argmax(axis=1)
                        yield pd.DataFrame({"id": pdf["id"], "cluster": ids[at], "similarity": s[np.arange(len(s)), at]})
                    else:
                        yield pd.DataFrame({"id": pdf["id"], "cluster": -1, "similarity": np.full(len(pdf), -np.inf)})

        return points.select("id", "v").mapInPandas(run, "id long, cluster int, similarity double")

    each = _in_turn(centres.select("cluster", "centroid"), against)
    best = each.groupBy("id").agg(F.min_by(F.struct("cluster", "similarity"), F.struct(-F.col("similarity"), "cluster")).alias("b"))
    s = F.col("b.similarity")
    return best.select("id", F.when(s >= 1 - max_distance, F.col("b.cluster")).otherwise(-1).alias("cluster"), F.when(s > F.lit(float("-inf")), s).alias("similarity"))


def coherence(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, coherence, medoid): mean member-to-centroid cosine and the closest member (ties: the smallest id)."""
    s = points.join(centres.select("cluster", "centroid"), "cluster").select("cluster", "id", dot("v", "centroid").alias("s"))
    return s.groupBy("cluster").agg(F.avg("s").alias("coherence"), F.max_by("id", F.struct("s", -F.col("id"))).alias("medoid"))


def related(centres: DataFrame, families: DataFrame, least: float = RELATED) -> DataFrame:
    """(cluster_a < cluster_b, similarity) of clusters of different families: the centroids as query set, in blocks, against themselves."""
    c = centres.select("cluster", "centroid").join(families, "cluster")

    def against(held) -> DataFrame:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = held.value
            for pdf in it:
                rows = []
                for cluster, v in zip(pdf["cluster"], pdf["centroid"]):
                    s = matrix @ np.asarray(v, np.float64) if len(ids) else np.empty(0)
                    rows += [(cluster, int(ids[i]), float(s[i])) for i in np.flatnonzero((ids > cluster) & (s >= least))]
                yield pd.DataFrame(rows, columns=["cluster_a", "cluster_b", "similarity"])

        return c.select("cluster", "centroid").mapInPandas(run, "cluster_a int, cluster_b int, similarity double")

    fa, fb = (families.select(F.col("cluster").alias(f"cluster_{s}"), F.col("family").alias(f"family_{s}")) for s in "ab")
    found = _in_turn(c.select("cluster", "centroid"), against).join(fa, "cluster_a").join(fb, "cluster_b")
    return found.where("family_a <> family_b").select("cluster_a", "cluster_b", "similarity")


def novelty(members: DataFrame, space: DataFrame) -> DataFrame:
    """members (cluster, family, label) and space (family, n_labels) -> (cluster, modal_share, entropy, novelty); null labels don't vote."""
    size = members.groupBy("cluster", "family").agg(F.count(F.lit(1)).alias("size"))
    by = members.where("label is not null").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    total = by.groupBy("cluster").agg(F.sum("n").alias("t"))
    h = by.join(total, "cluster").groupBy("cluster").agg(F.max("n").alias("top"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias("h"))
    j = size.join(h, "cluster", "left").join(space, "family", "left")
    share = F.coalesce(F.col("top") / F.col("size"), F.lit(0.0))
    ent = F.coalesce(F.least(F.lit(1.0), F.col("h") / F.log(F.greatest(F.coalesce("n_labels", F.lit(0)), F.lit(2)).cast("double"))), F.lit(1.0))
    return j.select("cluster", share.alias("modal_share"), ent.alias("entropy"), (0.5 * (1 - share) + 0.5 * ent).alias("novelty"))


def is_novel(scored: DataFrame, threshold: float = 0.60, coherence: float = 0.45, persistence: float = 0.05) -> DataFrame:
    """scored (novelty, coherence, persistence) plus is_novel: novel, coherent and persistent at once; a null measure fails."""
    good = (F.col("novelty") >= threshold) & (F.col("coherence") >= coherence) & (F.col("persistence") >= persistence)
    return scored.withColumn("is_novel", F.coalesce(good, F.lit(False)))


def dominant_issue(members: DataFrame) -> DataFrame:
    """(cluster, issue): the most frequent issue of each cluster, ties to the smaller; clusters without any issue are left out."""
    n = members.where("issue is not null").groupBy("cluster", "issue").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cluster").agg(F.min_by("issue", F.struct(-F.col("n"), "issue")).alias("issue"))


def ablation(members: DataFrame, n_issues: int = 10) -> DataFrame:
    """members (cluster, family, label, issue) -> (issue, n_positive, auc): novelty as a detector of clusters whose issue was hidden.

    The n_issues issues that dominate most clusters (ties to the smaller) are hidden one at a time: their members stay in the cluster and lose
    their label. AUC of the novelty so scored against "dominated by the hidden issue"; issues without both kinds of cluster have none. One plan for all of them:
    label counts are taken once, and each hidden issue only leaves its own rows out of them. The label space is that of all labels.
    """
    truth = dominant_issue(members)
    hidden = truth.groupBy("issue").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "issue").limit(n_issues).select(F.col("issue").alias("hidden"))
    names = F.array(*(F.lit(r[0]) for r in hidden.collect()))  # at most n_issues
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    space = members.where("label is not null").agg(F.count_distinct("label")).first()[0]
    counts = members.where("label is not null").groupBy("cluster", "label", "issue").agg(F.count(F.lit(1)).alias("n"))
    each = counts.select("*", F.explode(names).alias("hidden")).where("not (issue <=> hidden)").groupBy("hidden", "cluster", "label").agg(F.sum("n").alias("n"))
    h = each.groupBy("hidden", "cluster").agg(F.max("n").alias("top"), F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("nln"))
    every = sizes.select("*", F.explode(names).alias("hidden")).join(h, ["hidden", "cluster"], "left").join(truth, "cluster", "left")
    ent = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log("t") - F.col("nln") / F.col("t")) / F.log(F.lit(float(max(space, 2)))))
    score = F.when(F.col("t").isNull(), 1.0).otherwise(0.5 * (1 - F.col("top") / F.col("size")) + 0.5 * ent)
    scored = every.select("hidden", F.round(score, 9).alias("score"), F.coalesce(F.col("issue") == F.col("hidden"), F.lit(False)).cast("long").alias("y"))
    w = Window.partitionBy("hidden").orderBy("score")
    by = scored.groupBy("hidden", "score").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("pos"))  # a row a distinct score
    ranks = by.withColumn("rank", F.sum("m").over(w) - (F.col("m") - 1) / 2)
    t = ranks.groupBy("hidden").agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("m") - F.col("pos")).alias("q")).where("p > 0 and q > 0")
    return t.select(F.col("hidden").alias("issue"), F.col("p").alias("n_positive"), ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def auc(scored: DataFrame) -> DataFrame:
    """scored (score, label 0/1) -> one row (auc): the rank-sum statistic with average ranks; null if a class is empty.

    Scores are ranked within 256 ranges of about equal size, each shifted by what lies below it, so no task sorts them all.
    """
    by = scored.where("score is not null and label is not null").groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    cuts = by.agg(F.percentile_approx(F.col("score").cast("double"), [i / 256 for i in range(1, 256)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    keyed = by.withColumn("part", part)
    sizes = keyed.groupBy("part").agg(F.sum("n").alias("m")).withColumn("below", F.sum("m").over(Window.orderBy("part")) - F.col("m")).select("part", "below")
    before = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sizes, "part").withColumn("rank", F.col("below") + F.col("within") + (F.col("n") + 1) / 2)
    t = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return t.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs (x, y) of two labellings, rows with a null left out -> (ari, nmi), NMI over the mean of both entropies."""
    c = pairs.where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = c.groupBy("x").agg(F.sum("n").alias("nx")), c.groupBy("y").agg(F.sum("n").alias("ny"))
    c2 = lambda v: v * (v - 1) / 2
    total = c.agg(F.sum("n").alias("n"))
    sx = rows.agg(F.sum(c2(F.col("nx"))).alias("sx"), F.sum(F.col("nx") * F.log("nx")).alias("lx"))
    sy = cols.agg(F.sum(c2(F.col("ny"))).alias("sy"), F.sum(F.col("ny") * F.log("ny")).alias("ly"))
    sc = c.agg(F.sum(c2(F.col("n"))).alias("sc"), F.sum(F.col("n") * F.log("n")).alias("lc"))
    parts = total.unionByName(sx, True).unionByName(sy, True).unionByName(sc, True)  # one row each
    j = parts.agg(*(F.max(c).alias(c) for c in ("n", "sx", "lx", "sy", "ly", "sc", "lc")))
    expected = F.col("sx") * F.col("sy") / c2(F.col("n"))
    ari = (F.col("sc") - expected) / ((F.col("sx") + F.col("sy")) / 2 - expected)
    hx, hy = F.log("n") - F.col("lx") / F.col("n"), F.log("n") - F.col("ly") / F.col("n")
    mi = F.log("n") + (F.col("lc") - F.col("lx") - F.col("ly")) / F.col("n")
    return j.select(ari.alias("ari"), (mi / ((hx + hy) / 2)).alias("nmi"))


def mmr_select(points: DataFrame, centres: DataFrame, nearest_k: int = 12, k: int = 20, weight: float = 0.5) -> DataFrame:
    """points (id, v, cluster) -> (cluster, id, nth): per cluster the nearest_k members closest to the centroid, then, up to k, each next by maximal marginal relevance.

    Relevance is the similarity to the centroid, redundancy the greatest similarity to a member chosen before; ties go to the smaller id. A round is one aggregate over all members and the
    chosen of a cluster are at most k, so clusters of any size are spread over tasks.
    """
    near = points.join(centres.select("cluster", "centroid"), "cluster").select("cluster", "id", "v", F.round(dot("v", "centroid"), 9).alias("near"))
    w = Window.partitionBy("cluster", "part").orderBy(F.desc("near"), "id")
    # the first ones: best of each of 64 parts of a cluster, then of those
    parted = near.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= nearest_k)
    first = parted.withColumn("part", F.lit(0)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= nearest_k)
    chosen = cut(first.select("cluster", "id", "v", "nth"))
    far = lambda: F.coalesce(F.round(F.max(dot("v", "w")), 9), F.lit(float("-inf")))
    state = cut(near.join(chosen.select("cluster", "id"), ["cluster", "id"], "left_anti").join(chosen.select("cluster", F.col("v").alias("w")), "cluster").groupBy("cluster", "id", "v", "near").agg(far().alias("apart")))
    for nth in range(nearest_k + 1, k + 1):
        value = F.lit(weight) * F.col("near") - F.lit(1 - weight) * F.col("apart")
        best = state.groupBy("cluster").agg(F.min_by(F.struct("id", "v"), F.struct(-F.round(value, 9), "id")).alias("b")).select("cluster", "b.id", "b.v")
        best = cut(best.withColumn("nth", F.lit(nth)))
        chosen = chosen.unionByName(best)
        left = state.join(best.select("cluster", "id"), ["cluster", "id"], "left_anti").join(best.select("cluster", F.col("v").alias("w")), "cluster")
        old, state = state, cut(left.select("cluster", "id", "v", "near", F.greatest("apart", F.round(dot("v", "w"), 9)).alias("apart")))
        drop_cut(old)
    return chosen.select("cluster", "id", "nth")


def wilson(successes, n, z: float = 1.959963984540054):
    """(low, high) of the Wilson interval as columns; (0, 0) for no trials."""
    p = successes / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (mid - half) / scale), F.least(F.lit(1.0), (mid + half) / scale)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)



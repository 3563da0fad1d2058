"""Density clusters of unit vectors on the nearest-neighbour graph, and the tests a clustering has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators import graph, ranges, vectors
from harborlight.session import cut

NOISE = -1


def sample(points: DataFrame, seed: str, n: int = 500_000) -> DataFrame:
    """At most n points, those of smallest seeded hash of the id: what clusters are fitted on. All other points are assigned to centroids afterwards."""
    return points.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), "id").limit(n)


def family_representatives(groups: DataFrame, rows: DataFrame, families: DataFrame) -> DataFrame:
    """groups (id, is_representative), rows (id, row_idx), families (id, family) -> (family, id, row_idx) of the representatives that have a vector and a family."""
    return groups.where("is_representative").join(rows, "id").join(families.where("family is not null"), "id").select("family", "id", "row_idx")


def too_small(families: DataFrame, min_cluster_size: int = 50) -> DataFrame:
    """families (family, ...) -> (family, n, clustered): a family of fewer than max(31, 2 min_cluster_size) points isn't clustered, and all its points are noise."""
    return families.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("clustered", F.col("n") >= max(31, 2 * min_cluster_size))


def density_clusters(points: DataFrame, k: int = 10, least: float = 0.65, min_size: int = 50) -> DataFrame:
    """points (id, v) -> (id, cluster, core): clusters are numbered 0, 1, ... from the largest (ties: the smallest id), NOISE for the rest.

    core is the similarity of a point's k-th neighbour. Points whose core reaches `least` are dense; a dense point and a dense one among its k neighbours, at least that similar, are in one
    cluster, and so on; of the clusters those of min_size and more are kept. Exact neighbours, k rows a point; components by contraction. Meant for a fitted sample: the neighbour search
    holds every point against every other, in blocks.
    """
    near = cut(vectors.nearest(points, points, k))
    core = near.where(F.col("rank") == k).select("id", F.round("score", 9).alias("core"))
    dense = cut(core.where(F.col("core") >= least))
    ends = near.where(F.round("score", 9) >= least).select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    ends = ends.join(dense.select(F.col("id").alias("a")), "a", "left_semi").join(dense.select(F.col("id").alias("b")), "b", "left_semi")
    parts = graph.components(dense, ends)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    named = ranges.ranked(sizes, [], [F.desc("n"), "component"], "r").select("component", (F.col("r") - 1).cast("int").alias("cluster"))
    member = parts.join(named, "component").select("id", "cluster")
    return points.select("id").join(core, "id", "left").join(member, "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"), "core")


def persistence(clustered: DataFrame, least: float) -> DataFrame:
    """(cluster, size, persistence): how far above the bound its members' cores lie on average, as a share of what is possible; noise left out."""
    g = clustered.where(F.col("cluster") != NOISE).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("core").alias("c"))
    return g.select("cluster", "size", ((F.col("c") - least) / (1 - least)).alias("persistence"))


def stability(points: DataFrame, seed: str, held_out: float = 0.2) -> DataFrame:
    """points (id, v, cluster) -> one row (n, ari): centroids from two disjoint halves, both used to assign the same held-out points, carved off first; how well do they agree.

    The split is by a seeded hash, so it can be drawn again. Clusters that a half lacks can't be assigned from it.
    """
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    p = cut(points.withColumn("__u", u))
    test, half = p.where(F.col("__u") < held_out), held_out + (1 - held_out) / 2
    a, b = (vectors.centroids(p.where(cond)) for cond in ((F.col("__u") >= held_out) & (F.col("__u") < half), F.col("__u") >= half))
    x, y = (vectors.assign(test, c, 2.0).select("id", F.col("cluster").alias(n)) for c, n in ((a, "x"), (b, "y")))
    both = cut(x.join(y, "id"))
    n = both.agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(vectors.agreement(both).select("ari"), True).agg(F.max("n").alias("n"), F.max("ari").alias("ari"))  # one row each


def units(members: DataFrame, by: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Baseline clusters: (unit, *by, n_members), every distinct tuple of `by` numbered from 0 in order (nulls first), and (key, unit) for each member."""
    n = members.groupBy(*by).agg(F.count_distinct(key).alias("n_members"))
    numbered = cut(ranges.ranked(n, [], [F.asc_nulls_first(c) for c in by], "r").select((F.col("r") - 1).alias("unit"), *by, "n_members"))
    on = F.lit(True)
    m, u = members.select(key, *by).distinct(), numbered.select("unit", *(F.col(c).alias(f"__{c}") for c in by))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return numbered, m.join(u, on).select(key, "unit")


def exemplars(members: DataFrame, k: int = 5) -> DataFrame:
    """members (cluster, id, is_exemplar, prob) -> (cluster, id, nth): per cluster the first k, exemplars first, then by membership, then id.

    The best k of each of 64 parts of a cluster meet, so a cluster of any size is many tasks.
    """
    order = [F.desc("is_exemplar"), F.desc_nulls_last("prob"), "id"]
    parted = members.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = parted.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "part").orderBy(*order))).where(F.col("r") <= k)
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("nth") <= k).select("cluster", "id", "nth")


def topics(texts: DataFrame, key: str, tokens: str, k: int, seed: int = 20260803, features: int = 50_000, min_df: int = 5, max_df: float = 0.5, iterations: int = 10) -> DataFrame:
    """(key, topic): the likeliest of k topics of each text by online latent Dirichlet allocation over TF-IDF weights, stop words and words in too few or too many texts left out.

    Texts without a known word have no topic and come out null.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover
    from pyspark.ml.functions import vector_to_array

    rows = texts.select(key, F.col(tokens).alias("__t")).where("__t is not null")
    plain = StopWordsRemover(inputCol="__t", outputCol="__w").transform(rows)
    counts = CountVectorizer(inputCol="__w", outputCol="__c", vocabSize=features, minDF=min_df, maxDF=max_df).fit(plain).transform(plain)
    weighted = cut(IDF(inputCol="__c", outputCol="features").fit(counts).transform(counts).select(key, "features"))
    model = LDA(k=k, seed=seed, optimizer="online", maxIter=iterations).fit(weighted)
    p = vector_to_array("topicDistribution")
    return model.transform(weighted).select(key, F.when(F.array_max(p) > 0, F.array_position(p, F.array_max(p)) - 1).cast("int").alias("topic"))

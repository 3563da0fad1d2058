"""Scoped retrieval: BM25, dense ranks, reciprocal rank fusion and retrieval measures."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators import vectors
from harborlight.session import cut, drop_cut

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


#: Bytes of query weights that a task holds; more queries go in turn.
BLOCK_BYTES = 64 << 20


def bm25(docs: DataFrame, queries: DataFrame, top: int = 50) -> DataFrame:
    """docs (doc_id, tokens), queries (query_id, tokens) -> (query_id, doc_id, score, rank), the `top` best of the documents that share a token with the query.

    Okapi weights; a term in more than half of the documents gets EPSILON times the mean idf. Repeated query tokens count
    repeatedly. Ties go to the smaller doc_id. One pass over the documents counts document frequencies, combined in each task; a second one scores them: the stated
    queries are a matrix of term weights that every task holds, in blocks of bounded size, and a batch keeps its `top` best of each query. No postings are shuffled.
    """
    docs = docs.where("doc_id is not null and tokens is not null")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    df = cut(docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("raw", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    mean = df.agg(F.avg("raw")).first()[0] or 0.0
    idf = F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
    weights = cut(asked.join(df, "term").select("query_id", "term", (F.col("qn") * idf).alias("w")))
    drop_cut(df)
    terms, asking = weights.select("term").distinct().count(), weights.select("query_id").distinct().count()
    blocks = max(1, -(-8 * terms * asking // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        mine = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else weights
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        found = docs.select("doc_id", "tokens").mapInPandas(_scorer(held, avgdl, top), "query_id long, doc_id long, score double")
        if blocks > 1:
            found = cut(found)
            held.destroy()
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, top)


def _scorer(held, avgdl: float, top: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = held.value
        asking = np.array(sorted({r[0] for r in rows}), np.int64)
        column, place = {q: i for i, q in enumerate(asking)}, {}
        for r in rows:
            place.setdefault(r[1], len(place))
        matrix, known = np.zeros((len(place), len(asking))), np.zeros((len(place), len(asking)), bool)
        for q, term, w in rows:
            matrix[place[term], column[q]], known[place[term], column[q]] = w, True
        for pdf in it:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                ids, scores = part["doc_id"].to_numpy(), np.full((len(part), len(asking)), -np.inf)
                for i, tokens in enumerate(part["tokens"]):
                    count = Counter(place[t] for t in tokens if t in place)
                    if count:
                        at, tf = np.fromiter(count, np.int64), np.fromiter(count.values(), float)
                        s = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / avgdl))) @ matrix[at]
                        scores[i] = np.where(known[at].any(axis=0), np.round(s, 9), -np.inf)
                s = scores.T
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :top]
                best = np.take_along_axis(s, order, 1)
                keep = np.isfinite(best).ravel()
                yield pd.DataFrame({"query_id": np.repeat(asking, order.shape[1])[keep], "doc_id": ids[order].ravel()[keep], "score": best.ravel()[keep]})

    return run


def dense(docs: DataFrame, queries: DataFrame, top: int = 50) -> DataFrame:
    """docs (doc_id, v), queries (query_id, v) -> (query_id, doc_id, score, rank) by cosine; vectors are scaled to length 1, zero vectors are left out."""

    def unit(df: DataFrame, key: str) -> DataFrame:
        length = F.sqrt(vectors.dot("v", "v"))
        return df.select(F.col(key).cast("long").alias("id"), "v", length.alias("l")).where("l > 0").select("id", F.transform("v", lambda x: x.cast("double") / F.col("l")).alias("v"))

    found = vectors.nearest(unit(queries, "query_id"), unit(docs, "doc_id"), top, same=False)
    return ranked(found.select(F.col("id").alias("query_id"), F.col("neighbour").alias("doc_id"), F.round("score", 9).alias("score")), top)


def variants(by_method: dict[str, DataFrame], top: int = 10) -> DataFrame:
    """(method, query_id, doc_id, score, rank) of several rankings side by side, their first `top`."""
    out = None
    for method, ranking in by_method.items():
        part = ranking.where(F.col("rank") <= top).select(F.lit(method).alias("method"), "query_id", "doc_id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def ranking_faults(ranking: DataFrame) -> DataFrame:
    """One row (queries, repeated, gaps, disordered): rankings in which a document comes twice, ranks aren't 1 to n, or a later score is higher."""
    by = ["method", "query_id"] if "method" in ranking.columns else ["query_id"]
    w = Window.partitionBy(*by).orderBy("rank")
    up = F.coalesce(F.col("score") > F.lag("score").over(w), F.lit(False))
    g = ranking.withColumn("__up", up).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("k"), F.max("__up").alias("up"))
    return g.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("d") < F.col("n")).alias("repeated"), F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("k") != F.col("n"))).alias("gaps"), F.count_if("up").alias("disordered"))


def ranked(scored: DataFrame, top: int | None = None) -> DataFrame:
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return out.where(F.col("rank") <= top) if top else out


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, top: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) by the sum of 1 / (k + rank) over both rankings."""
    d = dense.select("query_id", "doc_id", F.col("rank").alias("rd"))
    s = sparse.select("query_id", "doc_id", F.col("rank").alias("rs"))
    one = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return ranked(d.join(s, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", (one("rd") + one("rs")).alias("score")), top)


def ir_metrics(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_relevant, hits, recall, reciprocal_rank, first_rank) for each query with relevant documents."""
    rel = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hit = ranking.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"))
    j = rel.join(hit, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return j.select("query_id", "n_relevant", hits.alias("hits"), (hits / F.col("n_relevant")).alias("recall"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), "first_rank")


def win_tie_loss(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (wins, ties, losses) of a against b, by (recall, reciprocal rank)."""
    x = a.select("query_id", F.struct("recall", "reciprocal_rank").alias("x"))
    y = b.select("query_id", F.struct("recall", "reciprocal_rank").alias("y"))
    return x.join(y, "query_id").agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses"))


def macro(metrics: DataFrame) -> DataFrame:
    """metrics (method, recall, reciprocal_rank, hits) -> (method, n_queries, mean_recall, mrr, hit_rate)."""
    return metrics.groupBy("method").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"))


def evidence(expanded: DataFrame, order: list[str], cluster: str | None = None, company: str | None = None) -> DataFrame:
    """The scoped corpus: of expanded rows in their own family's cluster, the first by `order` of each (group, company), so that a group speaks once for a company. Null companies are one company."""
    own = expanded.where("cluster_id is not null and family = cluster_family")
    if cluster is not None:
        own = own.where(F.col("cluster_id") == cluster)
    if company is not None:
        own = own.where(F.col("company_id") == company)
    rest = [c for c in own.columns if c not in ("group_id", "company_id")]
    first = own.groupBy("group_id", "company_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select("group_id", "company_id", "r.*")


def membership_hash(corpus: DataFrame, scope: list[str], key: str, version: str) -> DataFrame:
    """(scope, n, hash): what a scope's corpus consists of, as the digest of its keys' digests in order; equal members give equal hashes whatever the order of the rows."""
    each = corpus.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    return each.select(*scope, "n", F.sha2(F.concat_ws("|", F.lit(version), F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("hash"))

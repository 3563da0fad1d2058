"""The analysis-ready tables: complaints with company and family, redacted narratives, and what was lost on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import taxonomy
from harborlight.functions import text as T


def build_complaints(raw: DataFrame, alias: DataFrame, start: str | None = None) -> DataFrame:
    """raw complaints from `start` on, once each, with month, company and product family. Unknown spellings have no company; rows without date are left out if start is given.

    Rows delivered again unchanged count once. alias (alias_raw, company_id) is unique by spelling, so the join adds no rows.
    """
    if start is not None:
        raw = raw.where(F.col("date_received") >= F.lit(start).cast("date"))
    wanted = ["complaint_id", "date_received", "product", "sub_product", "issue", "sub_issue", "company_raw", "state", "tags", "company_response", "has_narrative"]
    rows = raw.where("complaint_id is not null").select(*wanted).distinct()
    named = rows.join(alias.select(F.col("alias_raw").alias("company_raw"), "company_id"), "company_raw", "left")
    known = taxonomy.with_family(named)
    return known.select(
        "complaint_id", "date_received", F.trunc("date_received", "month").alias("period_month"), "company_id", "product_family", "product_std", F.col("issue").alias("issue_std"), F.col("sub_issue").alias("sub_issue_std"),
        "state", "tags", "company_response", "has_narrative",
    )


def build_narratives(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_redacted, text_hash, char_len, redaction_count, n_<pattern>...) of each non-blank text, personal data replaced."""
    rows = texts.where(F.trim(text) != "").select(key, F.col(text).alias("__t"))
    done = T.redacted(rows, "__t", "text_redacted").drop("__t")
    names = [c for c in done.columns if c.startswith("n_")]
    total: Column = F.lit(0)
    for c in names:
        total = total + F.col(c)
    return done.select(key, "text_redacted", T.text_hash(F.col("text_redacted")).alias("text_hash"), F.length("text_redacted").alias("char_len"), total.alias("redaction_count"), *names)


def redaction_stats(narratives: DataFrame) -> DataFrame:
    """(pattern, n_hits, n_documents) over all narratives: hits of the pattern, and texts in which anything was replaced."""
    names = [c[2:] for c in narratives.columns if c.startswith("n_")]
    one = narratives.agg(*(F.sum(f"n_{c}").alias(c) for c in names), F.count_if(F.col("redaction_count") > 0).alias("__docs"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("pattern"), F.coalesce(c, F.lit(0)).alias("n_hits")) for c in names))).alias("r"), "__docs").select("r.pattern", "r.n_hits", F.col("__docs").alias("n_documents"))


def told(complaints: DataFrame, narratives: DataFrame, key: str, text: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Narratives that aren't blank, of complaints received from `start` to before `end`."""
    inside = complaints
    if start is not None:
        inside = inside.where(F.col("date_received") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside.where(F.col("date_received") < F.lit(end).cast("date"))
    return narratives.where(F.trim(text) != "").join(inside.select(key).distinct(), key, "left_semi")


def reconcile(source: DataFrame, loaded: DataFrame, key: str, most: float = 0.001) -> DataFrame:
    """One row (n_source, n_loaded, n_dropped, share, ok): rows without a key are dropped on loading; more than `most` of them is too many."""
    s, t = source.agg(F.count(F.lit(1)).alias("n_source"), F.lit(None).cast("long").alias("n_loaded")), loaded.agg(F.lit(None).cast("long").alias("n_source"), F.count(key).alias("n_loaded"))
    one = s.unionByName(t).agg(F.max("n_source").alias("n_source"), F.max("n_loaded").alias("n_loaded")).withColumn("n_dropped", F.col("n_source") - F.col("n_loaded"))
    return one.withColumn("share", F.col("n_dropped") / F.greatest("n_source", F.lit(1))).withColumn("ok", F.col("share") <= most)


def top(rows: DataFrame, by: str, n: int, count: str = "n") -> DataFrame:
    """The n most frequent values of a column with their counts; ties to the smaller value. Counts are taken over all rows."""
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), by).limit(n)


def build_companies(raw: DataFrame, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """raw (complaint_id, company_raw), manual (alias_raw, company_id) -> canonical (company_id, canonical_name, n_spellings, n_complaints) and alias (alias_raw, company_id, method).

    A spelling belongs to the slug of its normalised name unless a person said otherwise. A company's canonical name is that of its most frequent spelling (ties: the smaller).
    """
    n = raw.where("company_raw is not null").groupBy(F.col("company_raw").alias("alias_raw")).agg(F.count_distinct("complaint_id").alias("n"))
    named = n.withColumn("normal", T.company_normal(F.col("alias_raw"))).withColumn("own", T.slug(F.col("normal")))
    said = manual.groupBy("alias_raw").agg(F.min("company_id").alias("said")) if manual is not None else raw.sparkSession.createDataFrame([], "alias_raw string, said string")
    alias = named.join(said, "alias_raw", "left").select("alias_raw", F.coalesce("said", "own").alias("company_id"), F.when(F.col("said").isNotNull(), "manual").otherwise("exact").alias("method"), "normal", "n")
    canonical = alias.groupBy("company_id").agg(F.min_by("normal", F.struct(-F.col("n"), "alias_raw")).alias("canonical_name"), F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_complaints"))
    return canonical, alias.select("alias_raw", "company_id", "method")

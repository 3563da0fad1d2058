"""The queries of this subpackage, with production parameters over whole tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm import abuse, components, consistent, leakage, linkage, names, neardup, packing, pii
from harborlight.session import cut, read_table, ship_package


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    typed = read_table(spark, d, "company_alias").select(F.col("alias_raw").alias("spelling"))
    typed = typed.unionByName(read_table(spark, d, "complaints_raw").select(F.col("company_raw").alias("spelling")).distinct())
    return names.link_variants(typed, "spelling")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    aliases = read_table(spark, d, "company_alias").select(F.col("alias_raw").alias("alias")).distinct()
    return names.variant_pairs(cut(p1_groups(spark, d).join(aliases.hint("merge"), "alias", "left_semi")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    narratives = consistent.deceptive_records(read_table(spark, d, "narratives"), "complaint_id", "text_redacted", "narratives.text_redacted")
    companies = consistent.deceptive_records(read_table(spark, d, "complaints_raw"), "complaint_id", "company_raw", "complaints_raw.company_raw")
    return narratives.unionByName(companies)


def p2_consistent_narratives(spark: SparkSession, d: str) -> DataFrame:
    df = consistent.with_consistent(read_table(spark, d, "narratives").select("complaint_id", "text_redacted"), "text_redacted", "text_consistent")
    return df.select("complaint_id", "text_consistent")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicates(read_table(spark, d, "narratives"), "complaint_id", "text_redacted")
    return neardup.all_pairs(members, links)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    members, links = neardup.near_duplicates(read_table(spark, d, "narratives"), "complaint_id", "text_redacted")
    return neardup.classes(members, cut(links)).withColumnRenamed("id", "complaint_id")


def p4_weighted(spark: SparkSession, d: str) -> DataFrame:
    """As p4_classes, with pieces weighted by their number of occurrences: probability Jaccard similarity."""
    members, links = neardup.near_duplicates(read_table(spark, d, "narratives"), "complaint_id", "text_redacted", counted=True)
    return neardup.classes(members, cut(links)).withColumnRenamed("id", "complaint_id")


#: The key of the surrogates; a deployment passes its own.
SECRET = b"harborlight demonstration key"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, replaced = pii.pseudonymised(read_table(spark, d, "narratives"), "complaint_id", "text_redacted", SECRET)
    return replaced.where("surrogate is not null").select("complaint_id", "pii_type").distinct()


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    texts, _ = pii.pseudonymised(read_table(spark, d, "narratives"), "complaint_id", "text_redacted", SECRET)
    return texts


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    records, _ = linkage.cluster_records(read_table(spark, d, "narratives"), "complaint_id", "text_redacted")
    return records


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    records, nodes = linkage.cluster_records(read_table(spark, d, "narratives"), "complaint_id", "text_redacted")
    return linkage.describe(records, nodes, "complaint_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    told = p6_records(spark, d).where("cluster is not null").select("complaint_id", "cluster")
    a, b = (told.select(F.col("complaint_id").alias(f"complaint_id_{s}"), F.col("cluster").alias(f"cluster_{s}")) for s in "ab")
    pairs = read_table(spark, d, "cluster_review_pairs").select("complaint_id_a", "complaint_id_b")
    return pairs.join(a, "complaint_id_a").join(b, "complaint_id_b").where("cluster_a = cluster_b").select("complaint_id_a", "complaint_id_b").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    groups = components.connected_components(read_table(spark, d, "dup_pairs"), "complaint_id_a", "complaint_id_b")
    return groups.withColumnRenamed("id", "complaint_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per document with text: whether its pieces follow each other from 0 on, whether no container they lie in is overfull or has two pieces in one place, and whether only a document longer than a container is in pieces."""
    packed = cut(p8_containers(spark, d))
    return packing.verified(packed, "doc_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    model = abuse.fit_labelled(docs, "doc_id", "text", read_table(spark, d, "doc_labels"), "toxic")
    return abuse.score_documents(docs, "doc_id", "text", model, keep=("source",))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where("abusive").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(p10_scores(spark, d), "source")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_consistent_narratives, p4_found, p4_classes, p4_weighted, p5_found, p5_texts, p6_found, p6_records, p6_clusters, p7_found, p9_found, p9_passages, p9_items, p8_containers, p8_fill, p8_checked, p10_found, p10_scores, p10_sources)}


def queries() -> dict:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}

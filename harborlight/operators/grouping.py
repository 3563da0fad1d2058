"""Duplicate groups of a point in time, campaigns built on them, and how well they hold against labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.operators import dedup


def new_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """found (a, b, similarity) turned smaller id first, once a pair (the greatest similarity), without self-pairs and pairs that known (a, b) has in either order."""
    turned = found.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    have = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return turned.join(have, ["a", "b"], "left_anti")


def _finished(assigned: DataFrame, order: list[str]) -> DataFrame:
    """assigned (id, group_id, *order) plus group_size and is_representative: the first of the group by the order. One aggregate a group, so a group of any size is many partial ones."""
    g = assigned.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"), F.min_by("id", F.struct(*order)).alias("__first"))
    return assigned.join(g, "group_id").select("id", "group_id", "group_size", (F.col("id") == F.col("__first")).alias("is_representative"))


def assign_groups(texts: DataFrame, links: DataFrame, before: str | None = None) -> DataFrame:
    """texts (id, h, day) and links (a, b) -> (id, group_id, group_size, is_representative) as known on the eve of `before`.

    Equal texts are one from the start, standing as their smallest id; star clusters of those over links whose both ends stand for a text in scope; a group is named after its seed. The
    representative is the earliest member (ties: the smaller id). Singletons are groups of one. Grouping depends on the date, so it is computed anew for each cutoff; links don't.
    """
    if before is not None:
        texts = texts.where(F.col("day") < F.lit(before).cast("date"))
    rep = texts.groupBy("h").agg(F.min("id").alias("rep"))
    each = texts.join(rep, "h").select("id", "day", "rep")
    nodes = rep.select(F.col("rep").alias("id"))
    ends = links.join(nodes.withColumnRenamed("id", "a"), "a", "left_semi").join(nodes.withColumnRenamed("id", "b"), "b", "left_semi")
    star = dedup.star_clusters(nodes, ends).select(F.col("id").alias("rep"), F.concat(F.lit("g"), F.col("seed").cast("string")).alias("group_id"))
    return _finished(each.join(star, "rep").select("id", "day", "group_id"), ["day", "id"])


def identity_groups(texts: DataFrame, before: str | None = None) -> DataFrame:
    """As assign_groups, without any grouping: every text is its own group and representative."""
    if before is not None:
        texts = texts.where(F.col("day") < F.lit(before).cast("date"))
    return texts.select("id", F.concat(F.lit("g"), F.col("id").cast("string")).alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("is_representative")).distinct()


def build_campaigns(members: DataFrame, min_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """members (group_id, id, day, family, state, company, char_len, text) -> campaigns, one row a group of min_size or more with its features, signals and flag; and campaign_members (id, group_id)."""
    base = dedup.concentration(members, "family", "state", "base_state").join(dedup.concentration(members, "family", "company", "base_company"), "family")
    span = members.groupBy("group_id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.mode("company", True).alias("top_company"))
    c = dedup.campaign_flags(dedup.campaign_features(members), base, min_size).where(F.col("n_complaints") >= min_size).join(span, "group_id")
    return c, members.join(c.select("group_id"), "group_id", "left_semi").select("id", "group_id")


def flagged_share(members: DataFrame, flagged: DataFrame) -> DataFrame:
    """(family, n, n_flagged, share) of members (group_id, family) in flagged groups (group_id)."""
    j = members.join(flagged.select("group_id").distinct().withColumn("__f", F.lit(1)), "group_id", "left")
    return j.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count("__f").alias("n_flagged"), F.avg(F.coalesce("__f", F.lit(0))).alias("share"))


def _draw(key: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), key), 256)


def evaluation_pairs(links: DataFrame, pool: DataFrame, seed: str, n: int = 100) -> DataFrame:
    """(a, b, stratum): n obvious pairs (similarity from .98), n hard ones (.70 to .93), and n unrelated ones of a family without a link between them, each drawn by a seeded hash.

    links (a < b, similarity), pool (id, family). Unrelated pairs are met among the 40 n pool members of smallest hash, which is a parameter of the sample, each with the next of its family.
    """
    pair = F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"))
    drawn = [
        links.where(cond).select("a", "b", F.lit(stratum).alias("stratum")).distinct().orderBy(_draw(pair, seed), "a", "b").limit(n)
        for stratum, cond in (("obvious", "similarity >= 0.98"), ("hard", "similarity between 0.70 and 0.93"))
    ]
    some = pool.where("family is not null").distinct().withColumn("h", _draw(F.col("id").cast("string"), seed)).orderBy("h", "id").limit(40 * n)
    w = Window.partitionBy("family").orderBy("h", "id")  # over the bounded draw
    beside = some.withColumn("other", F.lead("id").over(w)).where("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    apart = beside.join(links.select("a", "b").distinct(), ["a", "b"], "left_anti").orderBy(_draw(pair, seed), "a", "b").limit(n).select("a", "b", F.lit("unrelated").alias("stratum"))
    return drawn[0].unionByName(drawn[1]).unionByName(apart)


def label_pairs(pairs: DataFrame, texts: DataFrame, k: int = 5, threshold: float = 0.88) -> DataFrame:
    """pairs (a, b, ...) plus true_jaccard of the k-character pieces of texts (id, text) and is_dup; pairs of which a text is missing are left out."""
    s = lambda side: texts.where("text is not null").select(F.col("id").alias(side), T.shingles(F.col("text"), k).alias(f"s_{side}"))
    j = pairs.join(s("a"), "a").join(s("b"), "b").withColumn("true_jaccard", F.round(T.jaccard(F.col("s_a"), F.col("s_b")), 4)).drop("s_a", "s_b")
    return j.withColumn("is_dup", F.col("true_jaccard") >= threshold)


def same_group(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs (a, b, ...) plus same: both are in groups (id, group_id) and in one group."""
    g = lambda side: groups.select(F.col("id").alias(side), F.col("group_id").alias(f"g_{side}"))
    return pairs.join(g("a"), "a", "left").join(g("b"), "b", "left").withColumn("same", F.coalesce(F.col("g_a") == F.col("g_b"), F.lit(False))).drop("g_a", "g_b")


def gate_report(judged: DataFrame) -> DataFrame:
    """judged (stratum, is_dup, same) -> (stratum, n, tp, fp, fn, precision, recall) by stratum and for all; a ratio without a denominator is null."""
    each = judged.unionByName(judged.withColumn("stratum", F.lit("all")))
    p, a = F.col("same"), F.col("is_dup")
    g = each.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    return g.select("*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def merge_audit(groups: DataFrame, links: DataFrame, seed: str, least: int = 100, n: int = 300) -> DataFrame:
    """(group_id, a, b, direct) of one random pair from each of at most n groups of `least` or more members: is there a link, or do they only meet through the seed?

    groups (id, group_id). The pair is the two members of smallest seeded hash: partial aggregates, so a group of any size is many tasks.
    """
    h = F.struct(_draw(F.col("id").cast("string"), seed).alias("h"), "id")
    first = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("m"), F.min(h).alias("x")).where(F.col("m") >= least)
    second = groups.join(first.select("group_id", F.col("x.id").alias("xid")), "group_id").where("id <> xid").groupBy("group_id", "xid").agg(F.min(h).alias("y"))
    drawn = second.orderBy(_draw(F.col("group_id"), seed), "group_id").limit(n).select("group_id", F.least("xid", F.col("y.id")).alias("a"), F.greatest("xid", F.col("y.id")).alias("b"))
    have = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("__l", F.lit(True))
    return drawn.join(have, ["a", "b"], "left").select("group_id", "a", "b", F.coalesce("__l", F.lit(False)).alias("direct"))

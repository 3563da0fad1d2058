"""What people get to judge, and how their judgements add up: populations, stratified draws, agreement, citations, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators import vectors


def label_population(clusters: DataFrame, fired: DataFrame, seed: str, controls: int = 20, least: int = 30) -> DataFrame:
    """clusters (cluster_id, n_members), fired (cluster_id) -> (cluster_id, n_members, fired): fired clusters of `least` members or more, and `controls` of the others by a seeded hash."""
    big = clusters.where(F.col("n_members") >= least).join(fired.select("cluster_id").distinct().withColumn("__f", F.lit(True)), "cluster_id", "left").withColumn("fired", F.coalesce("__f", F.lit(False))).drop("__f")
    draw = F.sha2(F.concat(F.lit(seed), F.col("cluster_id").cast("string")), 256)
    return big.where("fired").unionByName(big.where("not fired").orderBy(draw, "cluster_id").limit(controls))


def stratified_draw(candidates: DataFrame, strata: list[str], key: str, seed: str, per: int) -> DataFrame:
    """At most `per` candidates of each stratum, in the order of a seeded hash; the best of each of 64 parts of a stratum meet, so a stratum of any size is many tasks."""
    h = candidates.withColumn("draw", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(64)))
    some = h.withColumn("__r", F.row_number().over(Window.partitionBy(*strata, "__part").orderBy("draw", key))).where(F.col("__r") <= per)
    return some.withColumn("nth", F.row_number().over(Window.partitionBy(*strata).orderBy("draw", key))).where(F.col("nth") <= per).drop("__part", "__r")


def agreement_report(verdicts: DataFrame, by: list[str], item: str, agreed: str) -> DataFrame:
    """verdicts (item, agreed boolean, *by) -> (dimension, value, n_items, n, n_agreed, rate, low, high): overall and along each of `by`, with Wilson intervals. Null verdicts don't count."""
    judged = verdicts.where(F.col(agreed).isNotNull())
    dims = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))] + [F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("value")) for c in by]
    each = judged.select(item, F.col(agreed).cast("int").alias("__a"), F.explode(F.array(*dims)).alias("d"))
    g = each.groupBy("d.dimension", "d.value").agg(F.count_distinct(item).alias("n_items"), F.count(F.lit(1)).alias("n"), F.sum("__a").alias("n_agreed"))
    low, high = vectors.wilson(F.col("n_agreed").cast("double"), F.col("n").cast("double"))
    return g.withColumn("rate", F.col("n_agreed") / F.col("n")).withColumn("low", low).withColumn("high", high)


def citation_report(judged: DataFrame) -> DataFrame:
    """judged (answer_id, grounded boolean, n_cited) -> one row (answers, claims, grounded, validity, coverage, abstained): validity of claims, answers with a grounded claim, answers without any claim (null grounded)."""
    by = judged.groupBy("answer_id").agg(F.count("grounded").alias("c"), F.count_if(F.col("grounded")).alias("g"))
    t = by.agg(F.count(F.lit(1)).alias("answers"), F.sum("c").alias("claims"), F.sum("g").alias("grounded"), F.count_if(F.col("g") > 0).alias("covered"), F.count_if(F.col("c") == 0).alias("abstained"))
    return t.select("answers", "claims", "grounded", F.try_divide("grounded", "claims").alias("validity"), F.try_divide("covered", "answers").alias("coverage"), "abstained")


def usage_rollup(events: DataFrame, by: list[str], amount: str, outcome: Column) -> DataFrame:
    """(*by, n, total, mean, n_ok, n_failed): events, their amounts, and outcomes; a null outcome is neither."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"), F.avg(amount).alias("mean"), F.count_if(outcome).alias("n_ok"), F.count_if(~outcome).alias("n_failed"))


def context(actions: DataFrame, by: str, day: str, key: str, k: int = 5) -> DataFrame:
    """The k latest actions of each value of `by`: by day descending, then key; null days come last."""
    order = [F.desc_nulls_last(day), key]
    parted = actions.where(F.col(by).isNotNull()).withColumn("__p", F.pmod(F.xxhash64(key), F.lit(64)))
    some = parted.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__p").orderBy(*order))).where(F.col("__r") <= k)
    return some.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= k).drop("__p", "__r")


#: Controls, formatting and direction marks, lone surrogates: what no question may hold.
UNSAFE = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}]"


def question_hash(c: Column) -> Column:
    """Digest of a question, case, white space and trailing marks aside; null if it is empty or holds an unsafe character other than white space."""
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\t\n\r ]+", " "))
    bare = F.regexp_replace(plain, r"[?.! ]+$", "")
    return F.when((bare != "") & ~F.regexp_replace(c, r"[\t\n\r]", " ").rlike(UNSAFE), F.sha2(bare, 256))


def with_verdicts(items: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """items plus judged: whether any verdict of the key exists."""
    return items.join(verdicts.select(key).distinct().withColumn("__j", F.lit(True)), key, "left").withColumn("judged", F.coalesce("__j", F.lit(False))).drop("__j")


def record(old: DataFrame, new: DataFrame, keys: list[str], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """old plus those rows of new whose key isn't there yet, once a key (the smallest row): recorded verdicts never change. Values outside `allowed` are refused."""
    for column, values in (allowed or {}).items():
        bad = new.where(~F.coalesce(F.col(column).isin(values), F.lit(False))).limit(1).collect()
        if bad:
            raise ValueError(f"{column} holds {bad[0][column]!r}; allowed are {values}")
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else new.distinct()
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti").select(*old.columns))

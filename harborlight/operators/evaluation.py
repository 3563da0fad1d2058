"""Point-in-time evaluation: cutoffs, outcomes, summaries, samples and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators import ranges
from harborlight.session import cut


def asof_cutoff(actions: DataFrame, cutoffs: list[str], day: str) -> DataFrame:
    """actions plus cutoff: the latest of the cutoffs strictly before the day; null if there is none. No join: cutoffs are a fixed list."""
    before = F.filter(F.array(*(F.lit(c).cast("date") for c in cutoffs)), lambda c: c < F.col(day).cast("date"))
    return actions.withColumn("cutoff", F.array_max(before))


def outcomes(actions: DataFrame, signals: DataFrame, runs: DataFrame, alpha: float = 0.05, min_groups: int = 15) -> DataFrame:
    """actions (action_id, company_id, day, cutoff), signals (run_id, company_id, period_month, groups, q, method), runs (run_id, cutoff)
    -> (action_id, run_id, detected, first_signal, lead_days). An action without a run of its cutoff is no miss: run_id is null."""
    own = actions.join(runs.select("cutoff", "run_id"), "cutoff", "left")
    good = signals.where((F.col("groups") >= min_groups) & ((F.coalesce("q", F.lit(1.0)) <= alpha) | F.col("method").isin("ewma", "pelt")))
    first = good.groupBy("run_id", "company_id").agg(F.min("period_month").alias("first_signal"))
    j = own.join(first, ["run_id", "company_id"], "left")
    return j.select("action_id", "run_id", F.when(F.col("run_id").isNotNull(), F.col("first_signal").isNotNull()).alias("detected"), "first_signal", F.date_diff(F.col("day").cast("date"), "first_signal").alias("lead_days"))


def summary(found: DataFrame) -> DataFrame:
    """One row (n, detected, detect_rate, median_lead, p25_lead, p75_lead): quartiles are the values at n // 4 and 3 n // 4 of the sorted leads.

    Leads are counted by value first, so the ordered pass is over distinct numbers of days. No detection gives null leads.
    """
    g = found.where("detected is not null").agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("detected"), F.median(F.when(F.col("detected"), F.col("lead_days"))).alias("median_lead"))
    by = found.where("detected").groupBy("lead_days").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy("lead_days")
    cum = by.withColumn("upto", F.sum("m").over(w)).withColumn("total", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda num: F.min(F.when(F.col("upto") > F.floor(F.col("total") * num / 4), F.col("lead_days")))
    q = cum.agg(at(1).alias("p25_lead"), at(3).alias("p75_lead"))
    both = g.unionByName(q, True)  # one row each
    one = both.agg(*(F.max(c).alias(c) for c in ("n", "detected", "median_lead", "p25_lead", "p75_lead")))
    return one.select("n", "detected", F.try_divide("detected", "n").alias("detect_rate"), "median_lead", "p25_lead", "p75_lead")


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in the order of a seeded hash of the key: a sample anyone can draw again."""
    return df.withColumn("draw", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).orderBy("draw", key).limit(n)


def near_miss_sample(pairs: DataFrame, threshold: float, band: float, n: int) -> DataFrame:
    """Every step-th pair of [threshold - band, threshold) in order of (similarity, a, b), about n of them."""
    inside = pairs.where((F.col("similarity") >= threshold - band) & (F.col("similarity") < threshold))
    step = max(1, inside.count() // n)
    part = F.floor(F.col("similarity") * 1000)
    local = Window.partitionBy("part").orderBy("similarity", "a", "b")
    keyed = inside.withColumn("part", part)
    sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("m")).withColumn("start", F.sum("m").over(Window.orderBy("part")) - F.col("m"))  # at most 1000 parts
    return keyed.withColumn("i", F.row_number().over(local)).join(sizes, "part").withColumn("position", F.col("start") + F.col("i") - 1).where(F.col("position") % step == 0).select("a", "b", "similarity", "position")


def precision_recall(scored: DataFrame, strict: bool = False) -> DataFrame:
    """scored (predicted, actual booleans) -> one row (tp, fp, fn, precision, recall, f1); an empty denominator gives null, or an error if strict: such a sample decides nothing."""
    p, a = F.col("predicted"), F.col("actual")
    g = scored.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    out = g.select("tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    if strict:
        r = out.first()
        if r["precision"] is None or r["recall"] is None:
            raise ValueError(f"nothing predicted or nothing actual: {r.asDict()}")
    return out


def shuffled(groups: DataFrame, family: str, key: str, value: str, seed: str) -> DataFrame:
    """groups with their values permuted within the family: the negative control. Positions in two orders are joined, not sampled; a family of any size is numbered by ranges."""
    groups = cut(groups.select(*groups.columns))
    a = ranges.ranked(groups, [family], [key], "i").drop("__range")
    b = groups.select(family, F.col(value).alias(f"shuffled_{value}"), F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256).alias("__h"), F.col(key).alias("__k"))
    b = ranges.ranked(b, [family], ["__h", "__k"], "i").select(family, "i", f"shuffled_{value}")
    return a.join(b, [family, "i"]).drop("i")


def month_gaps(rows: DataFrame, family: str, month: str) -> DataFrame:
    """(family, missing month) between a family's first and last month."""
    span = rows.groupBy(family).agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    grid = span.select(family, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias(month))
    return grid.join(rows.select(family, month).distinct(), [family, month], "left_anti")

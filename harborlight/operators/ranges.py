"""Ranks over an order of any length without a task that sees a whole family: range-partitioned, numbered in each range, shifted by what lies before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.session import cut


def ranked(df: DataFrame, family: list[str], order: list[Column | str], rank: str = "rank") -> DataFrame:
    """df plus `rank`, the row's number from 1 within its family by the order, and __range, which part of the order it is in.

    A column of that name is replaced. The order should be total, or ties are numbered as they come. Null values are ordered as Spark does; an empty table stays empty. df is written
    once, so that the ranges don't change when a task is run again. Only (family, range, rows) is ever held in one place.
    """
    keys = [*map(F.col, family), *(F.col(c) if isinstance(c, str) else c for c in order)]
    parted = cut(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", *family).orderBy(*order)
    sizes = parted.groupBy(F.col("__range").alias("__g"), *(F.col(f).alias(f"__k{i}") for i, f in enumerate(family))).agg(F.count(F.lit(1)).alias("__m"))
    names = [f"__k{i}" for i in range(len(family))]
    before = Window.partitionBy(*names).orderBy("__g") if family else Window.orderBy("__g")
    shifts = sizes.withColumn("__before", F.sum("__m").over(before) - F.col("__m")).drop("__m")
    on = F.col("__range") == F.col("__g")
    for f, k in zip(family, names):
        on = on & F.col(f).eqNullSafe(F.col(k))
    rows = parted.withColumn("__nth", F.row_number().over(inside)).join(shifts, on)
    return rows.select(*(F.col(f"`{c}`") for c in parted.columns if c != rank), (F.col("__nth") + F.col("__before")).alias(rank))

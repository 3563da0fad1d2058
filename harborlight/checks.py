"""Data expectations: one aggregate each, raising with what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CheckFailed(AssertionError):
    pass


def expect_rows(df: DataFrame, low: int, high: int | None = None) -> int:
    n = df.count()
    if n < low or (high is not None and n > high):
        raise CheckFailed(f"{n} rows; expected {low} to {high if high is not None else 'any number'}")
    return n


def expect_no_nulls(df: DataFrame, *columns: str) -> None:
    seen = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(str(i)) for i, c in enumerate(columns))).first()
    bad = {c: n for c, n in zip(columns, seen) if n}
    if bad:
        raise CheckFailed(f"nulls: {bad}")


def expect_unique(df: DataFrame, *columns: str) -> None:
    n = df.groupBy(*columns).count().where("count > 1").count()
    if n:
        raise CheckFailed(f"{n} values of {columns} occur more than once")


def expect_in(df: DataFrame, column: str, values: list) -> None:
    other = df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).limit(1).collect()
    if other:
        raise CheckFailed(f"{column} holds {other[0][column]!r}")


def expect_no_leakage(df: DataFrame, day: str, cutoff: str) -> None:
    """No row on or after the cutoff."""
    n = df.where(F.col(day) >= F.lit(cutoff).cast("date")).count()
    if n:
        raise CheckFailed(f"{n} rows on or after {cutoff}")


def schema_drift(df: DataFrame, wanted: StructType) -> dict[str, list[str]]:
    """Missing, extra and differently typed columns."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in wanted}
    return {
        "missing": sorted(set(want) - set(have)),
        "extra": sorted(set(have) - set(want)),
        "changed": sorted(n for n in set(want) & set(have) if want[n] != have[n]),
    }


def apply_schema(df: DataFrame, wanted: StructType) -> DataFrame:
    """df in the wanted columns, order and types: absent columns are null, extra ones left out; a value that doesn't fit its type is an error."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def reconcile_rows(mapped: DataFrame, vectors: DataFrame) -> dict[str, int]:
    """mapped (id, row_idx), vectors (row_idx): ids mapped twice, rows mapped without a vector, vectors nobody is mapped to."""
    twice = mapped.groupBy("id").count().where("count > 1").count()
    return {
        "mapped_twice": twice,
        "without_vector": mapped.select("row_idx").distinct().join(vectors, "row_idx", "left_anti").count(),
        "unused": vectors.select("row_idx").join(mapped.select("row_idx"), "row_idx", "left_anti").count(),
    }

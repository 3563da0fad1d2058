"""Per-key results when a few keys hold most rows: eager aggregation through joins.

Both inputs are reduced to one compact state a key before they meet: a partial aggregate in each task (map-side), then one
row a key and salt, then one a key. So the join sees each key once a side, a hot key costs no more than any other, and what a
join of the rows would have given follows algebraically: counts multiply, sums are scaled by the other side's count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.session import cut


def once(df: DataFrame) -> DataFrame:
    """Rows delivered again unchanged count once; the shuffle is by whole rows, so no key value is hot. repeats() does without it where states are all that is wanted."""
    return df.distinct()


def repeats(df: DataFrame, extra: str = "__extra") -> DataFrame:
    """The rows that occur more than once, once each, plus how often beyond the first.

    Only 64-bit hashes of the rows are shuffled; rows whose hash occurs again are then compared whole, so equal hashes of different rows do no harm. The hashes
    that occur again are written first: with their size known, few of them are broadcast and the rows stay where they are; many are joined by shuffling.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.select(*cols, F.xxhash64(*cols).alias("__h"))
    again = cut(df.select(F.xxhash64(*cols).alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select("__h"))
    met = hashed.join(again, "__h", "left_semi").drop("__h").groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    return met.where("__c > 1").select(*df.columns, (F.col("__c") - 1).alias(extra))


def key_states(df: DataFrame, keys: list[str], sums: list[str], distinct: dict[str, Column] | None = None) -> DataFrame:
    """One row a key: rows, sum_<c> for each c, n_<name> distinct values of each expression.

    Null keys are one group. With one distinct expression the states are by (key, value) first, which spreads a hot key over its
    values, and then rolled up: df is read once. More of them are counted beside each other.
    """
    distinct = distinct or {}
    if len(distinct) == 1:
        (name, value), = distinct.items()
        inner = df.withColumn("__v", value).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(f"sum_{c}") for c in sums))
        return inner.groupBy(*keys).agg(F.sum("rows").alias("rows"), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums), F.count("__v").alias(f"n_{name}"))
    plain = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(f"sum_{c}") for c in sums))
    for name, value in distinct.items():
        seen = df.select(*keys, value.alias("__v")).where("__v is not null").groupBy(*keys, "__v").agg(F.lit(1).alias("__one"))
        counted = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        plain = plain.join(counted, _same(plain, counted, keys), "left").select(*(plain[c] for c in plain.columns), F.coalesce(counted[f"n_{name}"], F.lit(0)).alias(f"n_{name}"))
    return plain


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def key_states_once(df: DataFrame, keys: list[str], sums: list[str], distinct: dict[str, Column] | None = None) -> DataFrame:
    """key_states() of the distinct rows of df, without shuffling the rows: the states of all rows less those of the repeats."""
    whole = key_states(df, keys, sums, distinct)
    more = repeats(df).groupBy(*keys).agg(F.sum("__extra").alias("__r"), *(F.sum(F.col(c) * F.col("__extra")).alias(f"__s_{c}") for c in sums))
    less = lambda c, m: (whole[c] - F.coalesce(more[m], F.lit(0))).alias(c)
    return whole.join(more, _same(whole, more, keys), "left").select(
        *(whole[k] for k in keys), less("rows", "__r"), *(less(f"sum_{c}", f"__s_{c}") for c in sums), *(whole[f"n_{n}"] for n in distinct or {})
    )


def join_states(a: DataFrame, b: DataFrame, keys: list[str], left_sums: list[str], right_sums: list[str], carry: list[str] | None = None, how: str = "inner") -> DataFrame:
    """The inner (or left) join of two tables of states by the keys: join_rows, left_<c>, right_<c> of what the join of all rows would have given.

    carry: columns that a's states are also by, kept in the result. In a left join a state without partner stands for its own rows
    (right sums null), matched_rows counting none of them. Null keys join nothing, as in SQL.
    """
    carry = carry or []
    a = a.select(*keys, *carry, F.col("rows").alias("__ra"), *(F.col(f"sum_{c}").alias(f"__a_{c}") for c in left_sums))
    b = b.select(*keys, F.col("rows").alias("__rb"), *(F.col(f"sum_{c}").alias(f"__b_{c}") for c in right_sums))
    times = F.coalesce("__rb", F.lit(1))
    out = [(F.col("__ra") * times).alias("join_rows"), (F.col("__ra") * F.coalesce("__rb", F.lit(0))).alias("matched_rows")]
    out += [(F.col(f"__a_{c}") * times).alias(f"left_{c}") for c in left_sums]
    out += [(F.col(f"__b_{c}") * F.col("__ra")).alias(f"right_{c}") for c in right_sums]
    return a.join(b, keys, how).select(*keys, *carry, *out)


def eager_join(left: DataFrame, right: DataFrame, keys: list[str], left_sums: list[str], right_sums: list[str], carry: list[str] | None = None, how: str = "inner") -> DataFrame:
    """What grouping the join of all rows by the keys (and the left's carry columns) would give, without making that join: both inputs are reduced to states first."""
    return join_states(key_states(left, [*keys, *(carry or [])], left_sums), key_states(right, keys, right_sums), keys, left_sums, right_sums, carry, how)


def roll_up(states: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Compact states summed to fewer keys."""
    return states.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))

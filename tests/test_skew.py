from collections import Counter, defaultdict

from pyspark.sql import functions as F

from harborlight.operators import skew


def test_states_and_eager_join_equal_the_joined_rows(spark):
    left = [("hot", i % 7, i) for i in range(200)] + [("cold", 1, 5), (None, 2, 3), ("hot", 1, 1), ("hot", 1, 1)]
    right = [("hot", 2)] * 5 + [("cold", 3), (None, 9), ("other", 1)]
    a = spark.createDataFrame(left, "key string, month int, n long")
    b = spark.createDataFrame(right, "key string, w long")
    got = {r["key"]: r for r in skew.key_states(a, ["key"], ["n"], {"months": F.col("month")}).collect()}
    rows, sums, months = Counter(k for k, _, _ in left), defaultdict(int), defaultdict(set)
    for k, m, n in left:
        sums[k] += n
        months[k].add(m)
    assert {k: (r["rows"], r["sum_n"], r["n_months"]) for k, r in got.items()} == {k: (rows[k], sums[k], len(months[k])) for k in rows}
    eager = {r["key"]: r for r in skew.eager_join(a, b, ["key"], ["n"], ["w"]).collect()}
    naive = {r["key"]: r for r in a.join(b, "key").groupBy("key").agg(F.count(F.lit(1)).alias("j"), F.sum("n").alias("n"), F.sum("w").alias("w")).collect()}
    assert {k: (r["join_rows"], r["left_n"], r["right_w"]) for k, r in eager.items()} == {k: (r["j"], r["n"], r["w"]) for k, r in naive.items()}


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "key string, n long")
    assert skew.key_states(empty, ["key"], ["n"], {"n": F.col("n")}).count() == 0
    assert skew.eager_join(empty, empty, ["key"], ["n"], []).count() == 0
    assert skew.once(spark.createDataFrame([("a", 1), ("a", 1), (None, None), (None, None)], "key string, n long")).count() == 2


def test_repeated_rows_count_once_without_shuffling_rows(spark):
    rows = [("a", 1, 1.5, "x")] * 3 + [("a", 1, 1.5, "y"), (None, 2, None, "x"), (None, 2, None, "x"), ("b", None, 4.0, None), ("a", 2, 1.0, "x")]
    df = spark.createDataFrame(rows, "k string, n int, v double, w string").repartition(3)
    assert {(*r,) for r in skew.repeats(df).collect()} == {("a", 1, 1.5, "x", 2), (None, 2, None, "x", 1)}
    distinct = {"w": F.col("w")}
    got, want = (sorted(map(str, f(d, ["k"], ["n", "v"], distinct).collect())) for f, d in ((skew.key_states_once, df), (skew.key_states, df.distinct())))
    assert got == want and skew.key_states_once(df.limit(0), ["k"], ["n"]).count() == 0


def test_left_join_of_states_is_the_join_of_rows(spark):
    left = spark.createDataFrame([(1, "p", 2), (1, "p", 3), (2, "q", 4), (None, "q", 5)], "k int, g string, n int")
    right = spark.createDataFrame([(1, 10), (1, 20), (3, 30), (None, 40)], "k int, m int")
    got = skew.roll_up(skew.eager_join(left, right, ["k"], ["n"], ["m"], carry=["g"], how="left"), ["g"], ["join_rows", "matched_rows", "left_n", "right_m"])
    rows = left.join(right, "k", "left").groupBy("g").agg(F.count(F.lit(1)).alias("join_rows"), F.count("m").alias("matched_rows"), F.sum("n").alias("left_n"), F.sum("m").alias("right_m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.select("g", "join_rows", "matched_rows", "left_n", "right_m").collect()))

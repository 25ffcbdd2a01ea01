"""Joins and running sums under hot keys, against plain forms."""

import pytest
from frames import rows
from pyspark.sql import functions as F
from pyspark.sql import Window

from edgelake.operators import scale


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows, a third of them on key 7 and some without a key."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(7)).when(n % 50 == 1, None).otherwise(n % 200)
    return spark.range(3000).select(n.alias("line"), key.cast("int").alias("key"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, hot, how):
    right = spark.range(0, 150, 2).select(F.col("id").cast("int").alias("key"), (F.col("id") * 10).alias("x"))
    right = right.unionByName(right.where("key < 10").withColumn("x", F.col("x") + 1))
    right = right.unionByName(spark.createDataFrame([(7, 1), (7, 2), (None, 3)], "key int, x long"))
    got = scale.skew_join(hot, right, ["key"], how)
    want = hot.join(right, "key", how).select(*got.columns)
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_skew_join_deals_a_hot_key_over_tasks(spark, hot):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        right = spark.range(200).select(F.col("id").cast("int").alias("key"), F.lit(1).alias("x"))
        joined = scale.skew_join(hot, right, ["key"])
        sizes = joined.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        plain = hot.join(right, ["key"]).groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert plain.max() >= 1000
        assert sizes.max() < 700
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_skew_join_refuses_joins_that_repeat_right_rows(spark, hot):
    with pytest.raises(ValueError):
        scale.skew_join(hot, hot, ["key"], "full")


def test_lookup_join_without_broadcast(spark, hot):
    right = spark.range(200).select(F.col("id").cast("int").alias("key"), F.lit(1).alias("x"))
    big = scale.lookup_join(hot, right, ["key"], small=False)
    small = scale.lookup_join(hot, right, ["key"])
    assert rows(big) == rows(small)


def test_is_small(spark):
    assert scale.is_small(spark.range(10), 10)
    assert not scale.is_small(spark.range(11), 10)


@pytest.mark.parametrize("width", [1, 7, 1000, 10**7])
def test_prefix_sum_is_a_running_sum(spark, hot, width):
    got = scale.prefix_sum(hot, "line", {"total": F.col("line") % 5, "n": F.lit(1)}, width=width)
    window = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumn("total", F.sum(F.col("line") % 5).over(window))
    assert rows(got, "line", "total") == rows(want, "line", "total")
    assert rows(got, "line", "n") == [(i, i + 1) for i in range(3000)]


def test_prefix_sum_by_group(spark, hot):
    keyed = hot.where("key IS NOT NULL")
    got = scale.prefix_sum(keyed, "line", {"n": F.lit(1)}, by=["key"], width=100)
    want = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("line")))
    assert rows(got, "line", "n") == rows(want, "line", "n")


@pytest.mark.parametrize("include_now", [False, True])
@pytest.mark.parametrize("horizon, slices", [(1, 32), (5, 1), (40, 7), (100, 32)])
def test_seen_recently_by_brute_force(spark, horizon, slices, include_now):
    events = [((i * 37) % 6, i) for i in range(300)]
    marks = [((i * 11) % 6, (i * i) % 300) for i in range(60)]
    got = scale.seen_recently(
        spark.createDataFrame(events, "key int, t long"),
        spark.createDataFrame(marks, "key int, m long"),
        "key", "t", "m", horizon, "seen", include_now, slices,
    )

    def near(diff):
        return 0 <= diff < horizon if include_now else 0 < diff <= horizon

    want = sorted((k, t, int(any(k == j and near(t - m) for j, m in marks))) for k, t in events)
    assert rows(got, "key", "t", "seen") == want


def test_a_burst_on_one_key_is_spread_over_tasks(spark):
    n = F.col("id")
    events = spark.range(4000).select(
        n.alias("line"),
        F.when(n % 2 == 0, F.lit(7)).otherwise(n % 500).cast("int").alias("key"),
        F.when(n % 2 == 0, F.lit(1000)).otherwise(n).alias("t"),
    )
    marks = spark.range(600).select((F.col("id") % 500).cast("int").alias("key"), F.col("id").alias("m"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = scale.seen_recently(events, marks, "key", "t", "m", 500, "seen")
        sizes = got.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.sum() == 4000 and sizes.max() <= 2 * 4000 / 16
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")

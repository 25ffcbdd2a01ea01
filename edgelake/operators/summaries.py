"""Windows as mergeable sketches: distinct nodes and both limits without reading the rows again.

A window has one row: a HyperLogLog sketch of the nodes that asked and a KLL sketch of the objects' counts. Rows of any windows
merge to those of longer spans, so a limit over a day reads 96 rows instead of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from edgelake.functions.clock import window_index
from edgelake.operators.features import get_requests
from edgelake.schemas import WINDOW_SECONDS, WINDOWS_PER_DAY
from edgelake.sources.tables import read_table

# Ranks of the two limits.
WINDOW_RANK, FLOOR_RANK = 0.95, 0.75
HLL_BITS = 12
KLL_SIZE = 400
SUMMARY = StructType([
    StructField("window_index", LongType()),
    StructField("objects", LongType()),
    StructField("nodes", BinaryType()),
    StructField("counts", BinaryType()),
    StructField("window_day", LongType()),
])


def window_summaries(features: DataFrame, requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``(window_index, objects, nodes, counts)`` of closed windows: of silver rows and the requests behind them."""
    counts = features.groupBy("window_index").agg(
        F.count(F.lit(1)).alias("objects"), F.kll_sketch_agg_bigint("req_count_current", KLL_SIZE).alias("counts")
    )
    window = window_index(F.col("ts"), seconds).alias("window_index")
    nodes = get_requests(requests).where(F.col("node_id").isNotNull()).groupBy(window).agg(
        F.hll_sketch_agg(F.col("node_id").cast("string"), HLL_BITS).alias("nodes")
    )
    return counts.join(nodes, "window_index", "left").select("window_index", "objects", "nodes", "counts")


def write_summaries(summaries: DataFrame, path: str) -> None:
    """Store windows in folders by day; a day that is written again replaces itself."""
    day = F.floor(F.col("window_index") / WINDOWS_PER_DAY).cast("bigint")
    (
        summaries.withColumn("window_day", day)
        .repartition("window_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_day")
        .parquet(path)
    )


def read_summaries(spark: SparkSession, path: str, days: tuple[int, int] | None = None) -> DataFrame:
    """Stored windows, of a range of days where one is given."""
    rows = read_table(spark, path, SUMMARY)
    return rows if days is None else rows.where(F.col("window_day").between(*days))


def window_limits(summaries: DataFrame) -> DataFrame:
    """``(window_index, p95_limit)`` of every window, from its own sketch."""
    limit = F.kll_sketch_get_quantile_bigint("counts", F.lit(WINDOW_RANK))
    return summaries.select("window_index", limit.alias("p95_limit"))


def merged(summaries: DataFrame, by: str = "window_day") -> DataFrame:
    """``(by, windows, objects, distinct_nodes, count_floor)`` of spans of windows, merged from their sketches."""
    spans = summaries.groupBy(by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("objects").alias("objects"),
        F.hll_union_agg("nodes").alias("nodes"),
        F.kll_merge_agg_bigint("counts").alias("counts"),
    )
    return spans.select(
        by, "windows", "objects",
        F.hll_sketch_estimate("nodes").alias("distinct_nodes"),
        F.kll_sketch_get_quantile_bigint("counts", F.lit(FLOOR_RANK)).alias("count_floor"),
    )

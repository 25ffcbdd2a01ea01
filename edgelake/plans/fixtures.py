"""The engine's inputs as views of the driver's tables.

Events stand for requests and log lines, nations for cache nodes, documents for stored content.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelake.functions.keys import object_id
from edgelake.operators.features import build_features
from edgelake.operators.labels import label_viral
from edgelake.operators.placement import first_touch_placement
from edgelake.operators.topology import hop_distances, neighborhood, undirected
from edgelake.session import stored, utc_timestamp

N_NODES = 25
MAX_HOP = 2
EDGE_MAX_HOP = 1
CLOUD_HOP = 10
DAY = 86400
LIMIT = 0.8
THRASH_LINES = 500


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """``(line_no, ts, object_id, node_id, operation)``."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("line_no"),
        utc_timestamp(spark, "ts").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("object_id"),
        F.pmod("user_id", F.lit(N_NODES)).cast("int").alias("node_id"),
        F.when(kind.isin("view", "click"), "get").otherwise(kind).alias("operation"),
    )


def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(line_no, value)``: log lines of the events, among them lines a parser has to drop."""
    n = F.col("line_no")
    plain = F.concat_ws(
        " ", n, F.concat(F.lit("obj-"), F.col("object_id")), F.lit("0"), F.lit("1024"), F.col("number"), F.col("op")
    )
    numbered = (
        table(spark, sf, "events")
        .select(
            (F.col("event_id") + 1).alias("line_no"),
            F.get_json_object("props", "$.k").alias("object_id"),
            F.when(F.col("event_id") % 13 == 5, F.concat(F.lit("u"), F.col("user_id")))
            .otherwise((F.col("user_id") - 50).cast("string"))
            .alias("number"),
            F.when(F.col("event_type").isin("view", "click"), F.when(F.col("event_id") % 3 == 0, "GET").otherwise("get"))
            .otherwise(F.col("event_type"))
            .alias("op"),
        )
    )
    value = (
        F.when(n == 1, F.concat(F.lit("time "), plain))
        .when(n % 19 == 4, F.lit("   "))
        .when(n % 11 == 7, F.concat_ws(",", n, F.lit("obj-short"), F.lit("0"), F.lit("7"), F.lit("8"), F.lit("")))
        .when(n % 7 == 2, F.concat(F.lit("  "), F.regexp_replace(plain, " ", " , ")))
        .when(n % 7 == 3, F.regexp_replace(plain, " ", ","))
        .otherwise(plain)
    )
    return numbered.select("line_no", value.alias("value"))


def event_records(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column]:
    rows = requests(spark, sf)
    return rows, F.col("line_no"), F.unix_millis("ts")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        key.cast("int").alias("node_id"), (40 + (key * 7) % 30).cast("int").alias("capacity")
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    node = nodes(spark, sf).select(F.col("node_id").alias("src"))
    ring = node.withColumn("dst", F.pmod(F.col("src") + 1, F.lit(N_NODES)).cast("int"))
    chord = node.withColumn("dst", F.pmod(F.col("src") * 7 + 3, F.lit(N_NODES)).cast("int"))
    return stored(undirected(ring.union(chord)), "edges")


def hops(spark: SparkSession, sf: str, max_hop: int | None = MAX_HOP) -> DataFrame:
    return hop_distances(edges(spark, sf), nodes(spark, sf), max_hop)


def neighbors(spark: SparkSession, sf: str, known_hops: DataFrame | None = None) -> DataFrame:
    """Neighbourhoods as a stored table: several steps of a query read it, and it is small."""
    distances = hops(spark, sf) if known_hops is None else known_hops
    return stored(neighborhood(distances, nodes(spark, sf), MAX_HOP), "neighbors")


def features(spark: SparkSession, sf: str, seconds: int = DAY) -> DataFrame:
    return build_features(requests(spark, sf), seconds)


def silver(spark: SparkSession, sf: str) -> DataFrame:
    """Day features as the stored table they are in the lake."""
    return stored(features(spark, sf), "features")


def placement(spark: SparkSession, sf: str) -> DataFrame:
    """Content of the caches after all requests, as a stored snapshot."""
    return stored(first_touch_placement(requests(spark, sf), nodes(spark, sf)), "placement")


def content(spark: SparkSession, sf: str) -> DataFrame:
    """``(node_id, object_id)`` of the documents: the node of their source, the id of their text."""
    return table(spark, sf, "documents").select(
        F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("node_id"),
        object_id(F.col("text")).alias("object_id"),
    ).distinct()


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """``(object_id, scored_at)``: objects labelled viral, flagged at the end of their day; stored."""
    marked = label_viral(silver(spark, sf)).where("is_viral_now = 1").select(
        F.col("curr_object_id").alias("object_id"),
        F.timestamp_seconds((F.col("window_index") + 1) * DAY).alias("scored_at"),
    )
    return stored(marked, "flags")


def evictions(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).where("operation = 'error'").select("object_id", "line_no")


def hot_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects to protect: those flagged on the last labelled day."""
    marked = flags(spark, sf)
    return marked.where(F.col("scored_at") == marked.agg(F.max("scored_at")).scalar()).select("object_id")

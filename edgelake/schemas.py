"""Table layouts and the fixed names and values shared with the systems around the engine."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The names, the order and the numbers are part of the data contract.
WINDOW_SECONDS = 900
WINDOWS_PER_DAY = 96
VIRAL_TTL_SECONDS = 900
VIRAL_THRESHOLD = 0.95
MIN_F1 = 0.4

FEATURE_COLS = [
    "hour_of_day",
    "hour_sin",
    "hour_cos",
    "active_edges_count",
    "req_count_current",
    "req_count_previous",
    "growth_rate",
]
TARGET_COL = "is_viral_next_window"

EVENT = StructType([
    StructField("timestamp_rel", LongType()),
    StructField("timestamp_abs", LongType()),
    StructField("key", LongType()),
    StructField("node_id", StringType()),
    StructField("operation", StringType()),
])

BRONZE = StructType([
    StructField("timestamp", TimestampType()),
    StructField("object_id", LongType()),
    StructField("node_id", StringType()),
    StructField("operation", StringType()),
])

SILVER = StructType([
    StructField("window_index", LongType()),
    StructField("hour_of_day", IntegerType()),
    StructField("hour_sin", DoubleType()),
    StructField("hour_cos", DoubleType()),
    StructField("curr_object_id", LongType()),
    StructField("active_edges_count", LongType()),
    StructField("req_count_current", LongType()),
    StructField("req_count_previous", LongType()),
    StructField("growth_rate", DoubleType()),
])
SILVER_KEYS = ["window_index", "curr_object_id"]

GOLD = StructType(SILVER.fields + [StructField(TARGET_COL, IntegerType())])

REGISTRY = StructType([
    StructField("object_id", LongType()),
    StructField("status", StringType()),
    StructField("scored_at", TimestampType()),
    StructField("expires_at", TimestampType()),
])

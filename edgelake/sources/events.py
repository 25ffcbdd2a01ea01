"""Event and feature messages (JSON in a key/value log)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from edgelake.functions.clock import event_time
from edgelake.schemas import EVENT, SILVER

# Topic names.
REQUEST_TOPIC = "edge_node_req_logs"
FEATURE_TOPIC = "cdn_features_stream"


def read_messages(spark: SparkSession, fmt: str = "kafka", path: str | None = None, **options: str) -> DataFrame:
    """Streaming key/value messages; the newest ones of the request topic unless options say else."""
    if fmt == "kafka":
        options = {"subscribe": REQUEST_TOPIC, "startingOffsets": "latest", **options}
    reader = spark.readStream.format(fmt).options(**options)
    if fmt != "kafka":
        reader = reader.schema("key string, value string")
    return reader.load(path) if path else reader.load()


def parse_events(messages: DataFrame) -> DataFrame:
    """Message values to bronze rows; a value that is not JSON gives a row of NULLs."""
    return _json_columns(messages.where(F.col("value").isNotNull()), EVENT).select(
        event_time(F.col("timestamp_abs")).alias("timestamp"),
        F.col("key").alias("object_id"),
        "node_id",
        "operation",
    )


def _json_columns(messages: DataFrame, schema: StructType) -> DataFrame:
    """Fields of the JSON values as columns; the generator keeps a value from being parsed per field."""
    return messages.select(F.inline(F.array(F.from_json(F.col("value").cast("string"), schema))))


def event_messages(requests: DataFrame, rel_ms: Column, abs_ms: Column) -> DataFrame:
    """Requests ``(object_id, node_id, operation)`` to messages keyed by object id."""
    record = F.struct(
        rel_ms.cast("bigint").alias("timestamp_rel"),
        abs_ms.cast("bigint").alias("timestamp_abs"),
        F.col("object_id").alias("key"),
        F.col("node_id"),
        F.col("operation"),
    )
    return requests.select(
        F.col("object_id").cast("string").alias("key"), F.to_json(record).alias("value")
    )


def feature_messages(features: DataFrame) -> DataFrame:
    """Feature rows to messages: the object id as key, all columns as JSON."""
    return features.select(
        F.col("curr_object_id").cast("string").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in features.columns])).alias("value"),
    )


def parse_feature_messages(messages: DataFrame) -> DataFrame:
    """Feature messages back to rows; those without an object id are dropped."""
    return _json_columns(messages, SILVER).where(F.col("curr_object_id").isNotNull())


def write_messages(messages: DataFrame, servers: str, topic: str = FEATURE_TOPIC) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

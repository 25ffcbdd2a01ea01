"""From event messages to bronze, silver, published features and the viral registry."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType

from edgelake.functions.clock import window_index
from edgelake.functions.keys import is_get
from edgelake.operators.features import add_hour_features, join_previous_count
from edgelake.operators.model import latest_version, load_model, score
from edgelake.operators.registry import viral_flags
from edgelake.schemas import FEATURE_COLS, REGISTRY, SILVER_KEYS, VIRAL_THRESHOLD, VIRAL_TTL_SECONDS
from edgelake.sources.events import feature_messages
from edgelake.sources.publishing import publish_once
from edgelake.sources.tables import (
    append_silver,
    batch_version,
    read_silver,
    read_table,
    run_id,
    silver_version,
    write_bronze,
)

log = logging.getLogger(__name__)

# Window, lateness and trigger of the feature stream.
WINDOW = "15 minutes"
LATENESS = "15 minutes"
TRIGGER = {"processingTime": "15 minutes"}


def windowed_features(events: DataFrame, window: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Bronze rows to counts per open window and object.

    Run in update mode a late row re-emits its window until the watermark has passed it.
    """
    seconds = int(window.split()[0]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[
        window.split()[1].rstrip("s")
    ]
    counts = (
        events.where(is_get(F.col("operation")))
        .withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", window).alias("w"), F.col("object_id").alias("curr_object_id"))
        .agg(
            F.approx_count_distinct("node_id").alias("active_edges_count"),
            F.count(F.lit(1)).alias("req_count_current"),
        )
        .withColumn("window_index", window_index(F.col("w.start"), seconds))
        .drop("w")
    )
    return add_hour_features(counts, seconds)


class SilverSink:
    """``foreachBatch`` step: previous counts from the silver store, append, publish.

    A batch's version in the store belongs to its stream (the checkpoint's) and its number, so a batch that is
    repeated replaces itself and a stream with a new checkpoint adds to what older ones stored. The previous count is looked up in what earlier batches stored; with ``include_batch`` also in the
    batch itself, which gives the value a batch job would. ``publish`` is called with the messages of a batch, again when it is
    repeated; in the folder ``published`` they appear once.
    """

    def __init__(
        self,
        path: str,
        publish: Callable[[DataFrame], None] | None = None,
        include_batch: bool = False,
        published: str | None = None,
    ):
        self.path = path
        self.publish = publish
        self.published = published
        self.include_batch = include_batch

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            self.write(batch, batch_id)
        finally:
            batch.unpersist()

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first, last = batch.agg(F.min("window_index"), F.max("window_index")).first()
        if first is None:
            return
        version = batch_version(spark, self.path, run_id(spark), batch_id)
        history = read_silver(spark, self.path, (first - 2, last), before_version=version).select(
            *SILVER_KEYS, "req_count_current"
        )
        if self.include_batch:
            own = batch.select(*SILVER_KEYS, "req_count_current")
            history = history.join(own, SILVER_KEYS, "left_anti").unionByName(own)
        append_silver(join_previous_count(batch, history), self.path, version)
        if self.publish or self.published:
            messages = feature_messages(silver_version(spark, self.path, version, (first, last)))
            if self.publish:
                self.publish(messages)
            if self.published:
                publish_once(messages, self.published, f"version-{version}")


class ScoringSink:
    """``foreachBatch`` step: score feature rows with the newest model and set viral flags.

    A newer model is taken up when its version appears; one that cannot be read leaves the loaded one in use. Without
    any model the batch fails, and so does one that cannot be written, so no batch is committed unscored. Rows
    without a feature cannot be scored and are left out. The registry is written before Spark commits the
    batch, and setting a flag twice is harmless.
    """

    def __init__(
        self,
        model_path: str,
        registry_path: str,
        threshold: float = VIRAL_THRESHOLD,
        ttl: int = VIRAL_TTL_SECONDS,
        now: Callable[[], Column] = F.current_timestamp,
    ):
        self.model_path = model_path
        self.registry_path = registry_path
        self.threshold = threshold
        self.ttl = ttl
        self.now = now
        self.version: int | None = None
        self.model = None

    def reload(self, spark: SparkSession) -> None:
        try:
            newest = latest_version(spark, self.model_path)
            if newest is not None and newest != self.version:
                self.model, self.version = load_model(spark, self.model_path, newest), newest
        except Exception:
            if self.model is None:
                raise
            log.exception("the newest model cannot be read, version %s stays in use", self.version)
        if self.model is None:
            raise RuntimeError(f"there is no model in {self.model_path}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.reload(spark)
        complete = batch.dropna(subset=FEATURE_COLS)
        scores = score(complete, self.model, self.threshold).withColumnRenamed("curr_object_id", "object_id")
        version = batch_version(spark, self.registry_path, run_id(spark), batch_id)
        append_flags(viral_flags(scores, self.now(), self.ttl), self.registry_path, version)


def append_flags(flags: DataFrame, path: str, version: int) -> None:
    """Flags set by one batch, in folders by day and version that a repeat replaces."""
    (
        flags.select(
            *REGISTRY.fieldNames(),
            F.to_date("scored_at").alias("scored_day"),
            F.lit(version).cast("bigint").alias("version"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scored_day", "version")
        .parquet(path)
    )


def read_registry(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """One row per object: its latest flag, of those set since a day when one is given.

    A flag lives minutes, so a lookup reads the last day or two and leaves older folders alone.
    """
    stored = StructType(
        [*REGISTRY.fields, StructField("scored_day", DateType()), StructField("version", LongType())]
    )
    flags = read_table(spark, path, stored)
    if since is not None:
        flags = flags.where(F.col("scored_day") >= F.lit(since).cast("date"))
    rest = [c for c in REGISTRY.fieldNames() if c != "object_id"]
    newest = flags.groupBy("object_id").agg(F.max_by(F.struct(*rest), F.struct("scored_at", "version")).alias("f"))
    return newest.select("object_id", "f.*")


def start_bronze(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return write_bronze(events, path, checkpoint, trigger)


def start_silver(
    events: DataFrame,
    sink: SilverSink,
    checkpoint: str,
    trigger: dict | None = None,
    window: str = WINDOW,
    lateness: str = LATENESS,
) -> StreamingQuery:
    return (
        windowed_features(events, window, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TRIGGER))
        .start()
    )


def start_scoring(
    features: DataFrame, sink: ScoringSink, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    return (
        features.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TRIGGER))
        .start()
    )


def start_lake(
    events: DataFrame, root: str, publish: Callable[[DataFrame], None] | None = None, trigger: dict | None = None
) -> list[StreamingQuery]:
    """Bronze and silver from one parsed source, each with a checkpoint of its own."""
    return [
        start_bronze(events, f"{root}/bronze", f"{root}/checkpoints/bronze", trigger),
        start_silver(events, SilverSink(f"{root}/silver", publish), f"{root}/checkpoints/silver", trigger),
    ]

"""Lake tables: scans, overwrites, keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from edgelake.schemas import SILVER, SILVER_KEYS, WINDOWS_PER_DAY
from edgelake.session import drop_tables


def read_table(
    spark: SparkSession, path: str | Sequence[str], schema: StructType, fmt: str = "parquet", base: str | None = None
) -> DataFrame:
    """Scan a table; one that does not exist yet reads as an empty frame of the same layout."""
    reader = spark.read.format(fmt)
    if fmt != "delta":
        reader = reader.schema(schema)
    if base:
        reader = reader.option("basePath", base)
    try:
        return reader.load(path if isinstance(path, str) else list(path))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "DELTA_TABLE_NOT_FOUND"):
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a whole table."""
    df.write.format(fmt).mode("overwrite").save(path)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows with the updated ones replaced and the new ones added."""
    return target.join(updates, list(keys), "left_anti").unionByName(updates)


def merge_into(updates: DataFrame, table: str, keys: Sequence[str]) -> None:
    """The same on a catalog table whose format has row-level changes (Delta, Iceberg)."""
    match = F.lit(True)
    for key in keys:
        match = match & (F.col(f"{table}.{key}") == F.col(f"updates.{key}"))
    updates.alias("updates").mergeInto(table, match).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, order: Sequence[str] = ()) -> None:
    """Replace a catalog table whose rows are dealt to files by ``key``.

    Windows and joins by the key read it without a shuffle, as long as both sides have the same number of buckets. One
    shuffle deals the rows before they are written, so that a bucket is one file.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    dealt = df.repartition(buckets, key).write.mode("overwrite").option("path", path)
    dealt.bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)


def upsert_bucketed(table: str, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``upsert`` on a bucketed table: the rows of the table stay where they are, only the updates are dealt to them."""
    target = updates.sparkSession.table(table)
    return upsert(target, updates.select(*target.columns), keys)


def write_bronze(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fmt: str = "parquet"):
    """Append every parsed event; returns the running query."""
    trigger = trigger or {"processingTime": "15 minutes"}
    return (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


# The silver store and the registry keep every version of a row as it was written: one folder per
# (day, version). Versions count up over all runs of a stream. A batch that runs again has the version of its
# first try and replaces its own folders only, so a write is safe to repeat, and no reader ever sees a row
# taken away. Reading keeps the newest version of every key. A store has one writer at a time.

_STORED = StructType(
    [*SILVER.fields, StructField("window_day", LongType()), StructField("version", LongType())]
)
_VERSIONS = StructType(
    [StructField("run", StringType()), StructField("batch_id", LongType()), StructField("version", LongType())]
)


def run_id(spark: SparkSession) -> str:
    """Id of the stream whose batch this is: kept in its checkpoint, and another one with a new checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def next_version(spark: SparkSession, path: str) -> int:
    return (_versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1


def batch_version(spark: SparkSession, path: str, run: str, batch_id: int) -> int:
    """The store's version for one batch of one run: the same whenever the batch is tried, and above all before it."""
    same = (F.col("run") == run) & (F.col("batch_id") == batch_id)
    known = _versions(spark, path).agg(F.max(F.when(same, F.col("version")))).first()[0]
    if known is not None:
        return known
    version = next_version(spark, path)
    _log_version(spark, path, run, batch_id, version)
    return version


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, f"{path}/_versions", _VERSIONS, "json")


def _log_version(spark: SparkSession, path: str, run: str, batch_id: int, version: int) -> None:
    spark.createDataFrame([(run, batch_id, version)], _VERSIONS).coalesce(1).write.mode("append").json(f"{path}/_versions")


def append_silver(df: DataFrame, path: str, version: int) -> None:
    """Write the rows of one version. Rebalancing gives a day few files, and several when it is large."""
    day = F.floor(F.col("window_index") / WINDOWS_PER_DAY).cast("bigint")
    (
        df.select(*SILVER.fieldNames(), day.alias("window_day"), F.lit(version).cast("bigint").alias("version"))
        .hint("rebalance", "window_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_day", "version")
        .parquet(path)
    )


def silver_version(spark: SparkSession, path: str, version: int, windows: tuple[int, int]) -> DataFrame:
    """The rows of one version, given its range of windows."""
    return _silver_rows(spark, path, windows).where(F.col("version") == version).select(*SILVER.fieldNames())


def read_silver(
    spark: SparkSession, path: str, windows: tuple[int, int] | None = None, before_version: int | None = None
) -> DataFrame:
    """Newest version of every (window, object); a window range limits the folders that are read."""
    rows = _silver_rows(spark, path, windows)
    if before_version is not None:
        rows = rows.where(F.col("version") < before_version)
    values = [c for c in SILVER.fieldNames() if c not in SILVER_KEYS]
    newest = rows.groupBy(*SILVER_KEYS).agg(F.max_by(F.struct(*values), "version").alias("v"))
    return newest.select(*[F.col(c) if c in SILVER_KEYS else F.col(f"v.{c}") for c in SILVER.fieldNames()])


def newest_window(spark: SparkSession, path: str) -> int | None:
    """The last window with rows: the last day by its folder, which no column is read for, and its last window."""
    rows = read_table(spark, path, _STORED)
    day = rows.agg(F.max("window_day")).first()[0]
    return rows.where(F.col("window_day") == day).agg(F.max("window_index")).first()[0]


def read_recent_silver(spark: SparkSession, path: str, windows: int) -> DataFrame:
    """The newest window and so many before it; the folders of earlier days are left alone."""
    newest = newest_window(spark, path)
    if newest is None:
        return read_table(spark, path, SILVER)
    return read_silver(spark, path, (newest - windows, newest))


def compact_silver(spark: SparkSession, path: str, first_day: int, last_day: int) -> int | None:
    """Put the newest rows of days that are over into one version, and delete the versions before it.

    Until the old folders are gone readers find rows twice and keep the newest, so a job that stops half-way
    does no harm and can run again. To be run by the writer of the store, between its batches.
    """
    windows = (first_day * WINDOWS_PER_DAY, (last_day + 1) * WINDOWS_PER_DAY - 1)
    rows = _silver_rows(spark, path, windows)
    old = [tuple(r) for r in rows.select("window_day", "version").distinct().collect()]
    if len(old) <= len({day for day, _ in old}):
        return None
    version = max(next_version(spark, path), 1 + max(v for _, v in old))
    _log_version(spark, path, "compaction", version, version)
    append_silver(read_silver(spark, path, windows), path, version)
    drop_tables(spark, [f"{path}/window_day={day}/version={v}" for day, v in old])
    return version


def _silver_rows(spark: SparkSession, path: str, windows: tuple[int, int] | None) -> DataFrame:
    rows = read_table(spark, path, _STORED)
    if windows is None:
        return rows
    first, last = windows
    days = F.col("window_day").between(first // WINDOWS_PER_DAY, last // WINDOWS_PER_DAY)
    return rows.where(days & F.col("window_index").between(first, last))

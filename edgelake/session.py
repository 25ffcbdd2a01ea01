"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
SHORT_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # A table bucketed by object serves joins by (window, object) as it lies.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    **STATE_STORE,
}


def build_session(app_name: str = "edgelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session inside the block; what it had comes back at its end."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def keyed_state(spark: SparkSession) -> AbstractContextManager[None]:
    """The state store that keyed state needs, for streams started inside; a stream keeps the settings it was started with."""
    return _settings(spark, STATE_STORE)


def short_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of the queries run inside go with their query, not when the driver's garbage collector finds them unused."""
    return _settings(spark, SHORT_SHUFFLES)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once, for a session started without it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="edgelake-package-")
    context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without the setting; there a temporary folder is as good.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="edgelake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path for a table of one run, unused so far."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table written once: no lineage behind it, and a size the planner knows. Its shuffle files go at once."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame as ``stored`` gives it, and the path of the table."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    tables = _scratch.get()
    if tables is not None:
        tables.append(path)
    with short_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that the block's thread stores are deleted at its end; what it yields is ``stored`` for tables that outlive it.

    These belong to the block around it, if there is one. No other frame of the block is to be read after it.
    """
    outer, tables = _scratch.get(), []

    def outlive(df: DataFrame, name: str) -> DataFrame:
        _scratch.set(outer)
        try:
            return stored(df, name)
        finally:
            _scratch.set(tables)

    _scratch.set(tables)
    try:
        yield outlive
    finally:
        _scratch.set(outer)
        drop_tables(spark, tables)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of this run that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def utc_timestamp(spark: SparkSession, col: str | Column) -> Column:
    """Zoneless timestamp read as UTC, whatever the time zone of the session is."""
    col = F.col(col) if isinstance(col, str) else col
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z"):
        col = F.convert_timezone(F.lit("UTC"), F.current_timezone(), col)
    return col.cast("timestamp")

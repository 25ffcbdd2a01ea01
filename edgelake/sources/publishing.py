"""A sink for messages that publishes every batch once, however often it is tried."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from edgelake.session import ship_package
from edgelake.sources.files import place
from edgelake.sources.tables import read_table

MESSAGES = StructType([StructField("key", StringType()), StructField("value", StringType())])
STAGING = "_staging"


@dataclass
class Staged(WriterCommitMessage):
    """A file that a task has written, not yet visible."""

    path: str


class PublishedMessages(DataSource):
    """Messages ``(key, value)`` in a folder with a subfolder per batch.

    Publishing has two steps. Tasks write to a staging folder that readers pass over. The commit gathers the files of all tasks
    in a folder and renames it to the name of the batch; a batch whose name is there was published by an earlier
    try, and what this try has staged is thrown away. So readers see a batch whole and once, also when a job dies before, in or
    after the commit. Batches are named by the option ``name`` (one for all streams of the folder, unless they differ in it) and
    the number of the batch. The store needs a rename in one step, as local disks and HDFS have.
    """

    @classmethod
    def name(cls) -> str:
        return "published_messages"

    def schema(self) -> StructType:
        return MESSAGES

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return StreamPublisher(self.options["path"], self.options.get("name", "stream"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BatchPublisher(self.options["path"], self.options["name"])


class _Publisher:
    def __init__(self, path: str, name: str):
        self.path, self.name = path.rstrip("/"), name

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, root = place(self.path)
        file = f"{root}/{STAGING}/{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{root}/{STAGING}", recursive=True)
        schema = pa.schema([("key", pa.string()), ("value", pa.string())])
        with system.open_output_stream(file) as out, pq.ParquetWriter(out, schema) as writer:
            for batch in batches:
                writer.write_table(pa.Table.from_batches([batch]).cast(schema))
        return Staged(file)

    def publish(self, staged: list[Staged | None], batch: str) -> None:
        system, root = place(self.path)
        target = f"{root}/batch={batch}"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            self.discard(staged)
            return
        gathered = f"{root}/{STAGING}/{batch}-{uuid.uuid4().hex}"
        system.create_dir(gathered, recursive=True)
        for message in staged:
            if message is not None:
                system.move(message.path, f"{gathered}/{message.path.rsplit('/', 1)[-1]}")
        system.move(gathered, target)

    def discard(self, staged: list[Staged | None]) -> None:
        system, _ = place(self.path)
        for message in staged:
            if message is not None and system.get_file_info(message.path).type == fs.FileType.File:
                system.delete_file(message.path)


class StreamPublisher(_Publisher, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.publish(messages, f"{self.name}-{batchId}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.discard(messages)


class BatchPublisher(_Publisher, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.publish(messages, self.name)

    def abort(self, messages: list[Staged | None]) -> None:
        self.discard(messages)


def publish_once(messages: DataFrame, path: str, batch: str) -> None:
    """Publish messages under the name of a batch; nothing happens when that batch is there already."""
    _register(messages.sparkSession)
    messages.select("key", "value").write.format("published_messages").option("name", batch).mode("append").save(path)


def publish_stream(
    messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, name: str = "stream"
) -> StreamingQuery:
    """Publish a stream of messages, every batch once. A stream with a new checkpoint needs a new ``name``."""
    _register(messages.sparkSession)
    writer = messages.select("key", "value").writeStream.format("published_messages").option("name", name)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 minutes"})).start(path)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """All published messages; none where nothing was published yet."""
    return read_table(spark, path, MESSAGES).select("key", "value")


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(PublishedMessages)

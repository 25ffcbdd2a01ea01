"""A streaming source that follows log files while they grow."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from edgelake.session import ship_package
from edgelake.sources.files import place, sizes
from edgelake.sources.logs import parse_simple_lines

BATCH_BYTES = 1 << 30
TASK_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
ROWS = 10_000


@dataclass
class Range(InputPartition):
    """Bytes ``low`` to ``high`` of a file, a part of those the batch has from ``begin`` to ``end``."""

    file: str
    begin: int
    end: int
    low: int
    high: int


class GrowingLines(DataSource):
    """Lines of a file, or of the files of a folder, as ``(file, position, value)``.

    Offsets are a number of bytes per file. A batch ends at the last line break of each file, so a line that is still being
    written waits; it takes at most ``batchBytes`` of a file (a longer line whole), except for the first batch after a
    restart, which takes what has come meanwhile. A task reads ``taskBytes``. A file that is shorter than it was is read from its beginning.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, position bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Follower(
            self.options["path"], int(self.options.get("batchBytes", BATCH_BYTES)), int(self.options.get("taskBytes", TASK_BYTES))
        )


class Follower(DataSourceStreamReader):
    def __init__(self, path: str, batch_bytes: int, task_bytes: int):
        self.path, self.batch_bytes, self.task_bytes = path, batch_bytes, task_bytes
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        system, path = place(self.path)
        out = {}
        for file, size in sizes(system, path).items():
            known = 0 if self.at is None else self.at.get(file, 0)
            known = 0 if known > size else known
            limit = size if self.at is None else min(size, known + self.batch_bytes)
            with system.open_input_file(file) as f:
                end = _last_break(f, known, limit)
                if end == known and limit < size:
                    end = _first_break(f, limit, size) or known
            out[file] = end
        return {**(self.at or {}), **out}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        out = []
        for file, stop in end.items():
            begin = start.get(file, 0) if start.get(file, 0) <= stop else 0
            out += [
                Range(file, begin, stop, low, min(low + self.task_bytes, stop)) for low in range(begin, stop, self.task_bytes)
            ]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range."""
        system, _ = place(self.path)
        with system.open_input_file(partition.file) as f:
            at = partition.low
            if at > partition.begin:
                at = _first_break(f, at - 1, partition.end) or partition.end
            held, positions, values = b"", [], []
            f.seek(at)
            read_to = at
            while at < partition.high and (held or read_to < partition.end):
                block = f.read(min(BLOCK_BYTES, partition.end - read_to))
                read_to += len(block)
                lines = (held + block).split(b"\n")
                held = lines.pop()
                for line in lines:
                    if at >= partition.high:
                        break
                    positions.append(at)
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                    if len(values) == ROWS:
                        yield _batch(partition.file, positions, values)
                        positions, values = [], []
                if not block:
                    break
            if values:
                yield _batch(partition.file, positions, values)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def _batch(file: str, positions: list[int], values: list[str]) -> pa.RecordBatch:
    columns = [pa.array([file] * len(values)), pa.array(positions, pa.int64()), pa.array(values, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["file", "position", "value"])


def _last_break(f: pa.NativeFile, low: int, high: int) -> int:
    """The place behind the last line break between two places; ``low`` where there is none."""
    while high > low:
        at = max(low, high - BLOCK_BYTES)
        f.seek(at)
        found = f.read(high - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        high = at
    return low


def _first_break(f: pa.NativeFile, low: int, high: int) -> int | None:
    """The place behind the first line break between two places."""
    f.seek(low)
    while low < high:
        block = f.read(min(BLOCK_BYTES, high - low))
        if not block:
            return None
        found = block.find(b"\n")
        if found >= 0:
            return low + found + 1
        low += len(block)
    return None


def follow_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Stream of the lines of growing files: ``(file, position, value)``."""
    ship_package(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(**options).load(path)


def follow_growing_log(spark: SparkSession, path: str, n_nodes: int, **options: str) -> DataFrame:
    """Stream of the requests in log files of white-space separated fields that go on growing."""
    return parse_simple_lines(follow_lines(spark, path, **options).select("value"), n_nodes)

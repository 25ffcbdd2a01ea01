"""Streams with keyed state of their own: flags that end by themselves, and counts that need no table lookups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from edgelake.functions.clock import window_index
from edgelake.functions.keys import is_get
from edgelake.functions.traffic import growth_rate
from edgelake.operators.features import add_hour_features
from edgelake.schemas import SILVER, VIRAL_TTL_SECONDS, WINDOW_SECONDS
from edgelake.sources.tables import append_silver, batch_version, read_silver, run_id
from edgelake.session import keyed_state, ship_package
from edgelake.streaming.jobs import LATENESS, TRIGGER

HOT, OVER = "hot", "over"
CHANGES = "object_id bigint, at_ms bigint, change string"
COUNTS = """window_index bigint, curr_object_id bigint, active_edges_count bigint, req_count_current bigint,
    req_count_previous bigint"""


class FlagLife(StatefulProcessor):
    """The life of an object's flag: ``hot`` when it is set, ``over`` when it ends.

    State is since when the object is hot and until when; a timer stands at the end. A flag set again before that moves the
    end and says nothing.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "since_ms bigint, until_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (object_id,) = key
        life = self.life.get() if self.life.exists() else None
        since, until = (life[0], life[1]) if life else (None, None)
        planned = until
        for at in sorted(row["scored_ms"] for row in rows):
            if since is not None and at + self.ttl < since:
                # A late flag whose life is over before the present one begins.
                yield Row(object_id=object_id, at_ms=at, change=HOT)
                yield Row(object_id=object_id, at_ms=at + self.ttl, change=OVER)
                continue
            if until is not None and at >= until:
                yield Row(object_id=object_id, at_ms=until, change=OVER)
                since = until = None
            if since is None:
                since = at
                yield Row(object_id=object_id, at_ms=at, change=HOT)
            until = max(until or 0, at + self.ttl)
        if until != planned:
            if planned is not None:
                self.handle.deleteTimer(planned)
            self.handle.registerTimer(until)
        self.life.update((since, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (object_id,) = key
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.life.exists() and self.life.get()[1] <= at:
            self.life.clear()
            yield Row(object_id=object_id, at_ms=at, change=OVER)

    def close(self) -> None:
        pass


def flag_changes(flags: DataFrame, ttl: int = VIRAL_TTL_SECONDS, lateness: str = "0 seconds") -> DataFrame:
    """Stream of ``(object_id, scored_at)`` to ``(object_id, at_ms, change)``, on the clock of the flags.

    An end is told when the watermark, the latest flag less ``lateness``, has passed it. Keyed state needs another state store than
    Spark's default: start the stream by ``start_flag_changes``, or inside ``keyed_state``.
    """
    ship_package(flags.sparkSession)
    timed = flags.withWatermark("scored_at", lateness).select(
        "object_id", "scored_at", F.unix_millis("scored_at").alias("scored_ms")
    )
    return timed.groupBy("object_id").transformWithState(FlagLife(ttl * 1000), CHANGES, "append", "eventTime")


def start_flag_changes(
    flags: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, ttl: int = VIRAL_TTL_SECONDS,
    lateness: str = "0 seconds",
) -> StreamingQuery:
    """The changes appended to a Parquet table, whatever state store the session has."""
    changes = flag_changes(flags, ttl, lateness).writeStream.format("parquet").outputMode("append")
    with keyed_state(flags.sparkSession):
        return changes.option("checkpointLocation", checkpoint).trigger(**(trigger or TRIGGER)).start(path)


class KeyedCounts(StatefulProcessor):
    """Requests and nodes of an object's open windows, and the count of the one before them.

    A batch emits the windows it touches, and the windows after them whose previous count it changes. Counts from ``initial`` (windows
    of an earlier stream) serve as previous counts only. Kept are the last two windows and those the watermark has not passed.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "windows array<bigint>, counts array<bigint>, nodes array<array<string>>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        windows, counts = list(initialState["windows"]), list(initialState["counts"])
        self.recent.update((windows, counts, [[] for _ in windows]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (object_id,) = key
        known: dict[int, tuple[int, set[str]]] = {}
        if self.recent.exists():
            windows, counts, nodes = self.recent.get()
            known = {w: (n, set(seen)) for w, n, seen in zip(windows, counts, nodes)}
        touched = set()
        for row in rows:
            window = row["window_index"]
            n, seen = known.get(window, (0, set()))
            if window not in touched and n and not seen:
                n = 0
            if row["node_id"] is not None:
                seen.add(row["node_id"])
            known[window] = (n + 1, seen)
            touched.add(window)
        after = {w + 1 for w in touched if w + 1 in known and known[w + 1][1]}
        for window in sorted(touched | after):
            n, seen = known[window]
            yield Row(
                window_index=window, curr_object_id=object_id, active_edges_count=len(seen), req_count_current=n,
                req_count_previous=known.get(window - 1, (0, None))[0],
            )
        passed = timerValues.getCurrentWatermarkInMs() // (1000 * self.seconds)
        kept = sorted(w for i, w in enumerate(sorted(known, reverse=True)) if i < 2 or w + 1 >= passed)
        self.recent.update((kept, [known[w][0] for w in kept], [sorted(known[w][1]) for w in kept]))

    def close(self) -> None:
        pass


def last_counts(silver: DataFrame, windows: int = 2) -> DataFrame:
    """``(object_id, windows, counts)``: the newest windows of every object, as initial state."""
    by_age = F.array_sort(F.collect_list(F.struct((-F.col("window_index")).alias("age"), "req_count_current")))
    newest = silver.groupBy(F.col("curr_object_id").alias("object_id")).agg(F.slice(by_age, 1, windows).alias("w"))
    return newest.select(
        "object_id",
        F.transform("w", lambda x: -x["age"]).alias("windows"),
        F.transform("w", lambda x: x["req_count_current"]).alias("counts"),
    )


def keyed_features(
    events: DataFrame, initial: DataFrame, seconds: int = WINDOW_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """Bronze rows to silver rows, previous counts from the state; run in update mode.

    ``initial`` (see ``last_counts``) fills the state of a stream whose checkpoint is new, and is not read after that.
    """
    ship_package(events.sparkSession)
    gets = events.where(is_get(F.col("operation")) & F.col("object_id").isNotNull()).withWatermark("timestamp", lateness)
    rows = gets.select(
        F.col("object_id").cast("bigint").alias("object_id"), "node_id", "timestamp",
        window_index(F.col("timestamp"), seconds).alias("window_index"),
    )
    counts = rows.groupBy("object_id").transformWithState(
        KeyedCounts(seconds), COUNTS, "update", "eventTime", initial.groupBy("object_id")
    )
    growth = growth_rate(F.col("req_count_current"), F.col("req_count_previous"))
    return add_hour_features(counts, seconds).withColumn("growth_rate", growth).select(*SILVER.fieldNames())


def start_keyed_silver(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, seconds: int = WINDOW_SECONDS,
    lateness: str = LATENESS, recent: tuple[int, int] | None = None,
) -> StreamingQuery:
    """The silver stream with keyed state: a batch reads no table, and writes what it emits under its own version.

    ``recent`` bounds the windows of the store that a new checkpoint starts from; the whole store without it.
    """
    spark: SparkSession = events.sparkSession
    initial = last_counts(read_silver(spark, path, recent) if recent else read_silver(spark, path))

    def store(batch: DataFrame, batch_id: int) -> None:
        append_silver(batch, path, batch_version(spark, path, run_id(spark), batch_id))

    with keyed_state(spark):
        return (
            keyed_features(events, initial, seconds, lateness)
            .writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or TRIGGER))
            .start()
        )

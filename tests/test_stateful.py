"""Streams with state, growing files and published batches, on scripted input with restarts."""

import os
import random
from datetime import datetime, timezone

import pytest
from frames import rows
from pyspark.sql import functions as F

from edgelake.operators.features import build_features
from edgelake.schemas import SILVER
from edgelake.sources import growing, publishing, tables
from edgelake.streaming import stateful

ONCE = {"availableNow": True}
T0 = 1704067200


def run(stream, root, mode="append"):
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/cp")
    writer.trigger(**ONCE).start(f"{root}/out").awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/out")


class Flags:
    def __init__(self, spark, root, ttl, lateness="0 seconds"):
        self.spark, self.root, self.ttl, self.lateness = spark, str(root), ttl, lateness

    def send(self, *flags):
        rows_ = [(o, datetime.fromtimestamp(T0 + t, tz=timezone.utc)) for o, t in flags]
        df = self.spark.createDataFrame(rows_, "object_id long, scored_at timestamp").coalesce(1)
        df.write.mode("append").parquet(f"{self.root}/in")
        source = self.spark.readStream.schema(df.schema).parquet(f"{self.root}/in")
        out = run(stateful.flag_changes(source, self.ttl, self.lateness), self.root)
        return [(o, at // 1000 - T0, change) for at, o, change in rows(out, "at_ms", "object_id", "change")]


def test_flags_end_by_themselves_over_restarts(spark, tmp_path):
    feed = Flags(spark, tmp_path, 900)
    assert feed.send((1, 0), (2, 100)) == [(1, 0, "hot"), (2, 100, "hot")]
    assert feed.send((2, 950)) == [(1, 0, "hot"), (2, 100, "hot"), (1, 900, "over")], "set again before its end"
    got = feed.send((3, 1900))
    assert got[-2:] == [(2, 1850, "over"), (3, 1900, "hot")]
    got = feed.send((1, 3000), (1, 3950), (9, 9000))
    assert got[5:] == [(3, 2800, "over"), (1, 3000, "hot"), (1, 3900, "over"), (1, 3950, "hot"), (1, 4850, "over"), (9, 9000, "hot")]


def test_late_flags_have_a_life_of_their_own(spark, tmp_path):
    feed = Flags(spark, tmp_path, 100, "1 hour")
    feed.send((1, 2000))
    assert feed.send((1, 500), (1, 1950)) == [(1, 500, "hot"), (1, 600, "over"), (1, 2000, "hot")]
    assert feed.send((2, 9000))[-2:] == [(1, 2100, "over"), (2, 9000, "hot")]


def silver_of(spark, events, root, half):
    events.coalesce(1).write.mode("append").parquet(f"{root}/in{half}")
    source = spark.readStream.schema(events.schema).parquet(f"{root}/in{half}")
    stateful.start_keyed_silver(source, f"{root}/silver", f"{root}/cp{half}", ONCE, lateness="1 hour").awaitTermination()


def test_keyed_counts_equal_a_batch_job(spark, tmp_path):
    rng = random.Random(2)
    events = [(T0 + rng.randrange(8 * 900), rng.randrange(5), f"n{rng.randrange(4)}", rng.choice(["get", "GET", "put"])) for _ in range(600)]
    schema = "t long, object_id long, node_id string, operation string"
    frame = lambda part: spark.createDataFrame(part, schema).select(F.timestamp_seconds("t").alias("timestamp"), "object_id", "node_id", "operation")
    early = [e for e in events if e[0] < T0 + 4 * 900]
    late = [e for e in early if e[0] % 7 == 0]
    for part in ([e for e in early if e not in late], late):
        silver_of(spark, frame(part), tmp_path, 0)
    silver_of(spark, frame([e for e in events if e[0] >= T0 + 4 * 900]), tmp_path, 1)
    got = tables.read_silver(spark, f"{tmp_path}/silver").drop("hour_sin", "hour_cos")
    want = build_features(frame(events).withColumnRenamed("timestamp", "ts")).select(*SILVER.fieldNames()).drop("hour_sin", "hour_cos")
    assert rows(got) == rows(want) and got.count() > 30


def test_a_batch_of_keyed_counts_reads_no_table(spark, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(stateful, "read_silver", lambda *a: read.append(a) or tables.read_silver(*a))
    event = spark.createDataFrame([(datetime(2024, 1, 1), 1, "a", "get")], "timestamp timestamp, object_id long, node_id string, operation string")
    silver_of(spark, event, tmp_path, 0)
    assert len(read) == 1, "for the initial state of the query only"


def follow(spark, root, **options):
    out = run(growing.follow_lines(spark, f"{root}/logs", **options), root)
    return [v for _, v in rows(out, "position", "value")]


def test_a_file_that_grows_is_read_line_by_line_once(spark, tmp_path):
    os.makedirs(tmp_path / "logs")
    log = tmp_path / "logs" / "a.log"
    log.write_bytes(b"one\ntwo\r\nthr")
    assert follow(spark, tmp_path) == ["one", "two"]
    with open(log, "ab") as f:
        f.write(b"ee\nfour")
    assert follow(spark, tmp_path) == ["one", "two", "three"]
    assert follow(spark, tmp_path) == ["one", "two", "three"], "a restart without new lines"
    with open(log, "ab") as f:
        f.write(b"\n\nlast\n")
    assert follow(spark, tmp_path) == ["one", "two", "three", "four", "", "last"]
    (tmp_path / "logs" / "b.log").write_text("other\n")
    (tmp_path / "logs" / ".hidden").write_text("no\n")
    assert sorted(follow(spark, tmp_path)) == sorted(["one", "two", "three", "four", "", "last", "other"])


def test_ranges_of_tasks_and_batches_cut_no_line(tmp_path, monkeypatch):
    rng = random.Random(1)
    lines = ["x" * rng.choice([0, 1, 5, 40, 300]) + str(i) for i in range(400)]
    log = tmp_path / "a.log"
    log.write_text("\n".join(lines) + "\nunfinished")
    for block, task, batch in ((7, 11, 50), (64, 100, 333), (1 << 20, 1 << 20, 1 << 30)):
        monkeypatch.setattr(growing, "BLOCK_BYTES", block)
        reader, start, got = growing.Follower(str(log), batch, task), {}, []
        assert reader.initialOffset() == {}
        while (end := reader.latestOffset()) != start:
            for part in reader.partitions(start, end):
                for read in reader.read(part):
                    got += zip(read.column("position").to_pylist(), read.column("value").to_pylist())
            begun = start.get(str(log), 0)
            assert end[str(log)] - begun <= max(batch, 310 + 1)
            start = end
        assert [v for _, v in sorted(got)] == lines and len(got) == len(set(got))


@pytest.mark.parametrize("after", [False, True])
def test_a_batch_that_dies_in_its_commit_is_published_once(spark, tmp_path, after):
    """The job dies between the write and the commit of the sink, or between that and the commit of the stream."""
    flag, root = str(tmp_path / "died"), str(tmp_path)

    class Dying(publishing.PublishedMessages):
        @classmethod
        def name(cls):
            return f"dying_{after}".lower()

        def streamWriter(self, schema, overwrite):
            inner = super().streamWriter(schema, overwrite)
            commit = inner.commit

            def die(messages, batch_id):
                if after:
                    commit(messages, batch_id)
                if not os.path.exists(flag):
                    open(flag, "w").close()
                    os._exit(1)
                if not after:
                    commit(messages, batch_id)

            inner.commit = die
            return inner

    spark.dataSource.register(Dying)
    for n in range(2):
        spark.range(5 * n, 5 * n + 5).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value")).write.mode("append").parquet(f"{root}/in")
        for attempt in range(2):
            stream = spark.readStream.schema("key string, value string").parquet(f"{root}/in")
            query = stream.writeStream.format(Dying.name()).option("checkpointLocation", f"{root}/cp").trigger(**ONCE).start(f"{root}/topic")
            try:
                query.awaitTermination()
                break
            except Exception:
                assert (n, attempt) == (0, 0)
                assert publishing.read_published(spark, f"{root}/topic").count() == (5 if after else 0)
    assert os.path.exists(flag)
    assert sorted(int(r["key"]) for r in publishing.read_published(spark, f"{root}/topic").collect()) == list(range(10))


def test_batches_by_name(spark, tmp_path):
    messages = spark.createDataFrame([("1", "a"), (None, "b")], "key string, value string")
    assert publishing.read_published(spark, str(tmp_path / "topic")).count() == 0
    for name in ("one", "one", "two"):
        publishing.publish_once(messages, str(tmp_path / "topic"), name)
    assert publishing.read_published(spark, str(tmp_path / "topic")).count() == 4
    publishing.publish_once(messages.where("false"), str(tmp_path / "topic"), "three")
    assert publishing.read_published(spark, str(tmp_path / "topic")).count() == 4


@pytest.fixture
def other_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, other)
    yield
    assert spark.conf.get(key) == other, "the session's own setting is left as it was"
    spark.conf.set(key, before)


def test_flags_need_no_setting_of_the_session(spark, tmp_path, other_state_store):
    for at, out in ((0, 1), (2000, 3)):
        flags = spark.createDataFrame([(1 + at, datetime.fromtimestamp(T0 + at, tz=timezone.utc))], "object_id long, scored_at timestamp")
        flags.write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(flags.schema).parquet(f"{tmp_path}/in")
        stateful.start_flag_changes(source, f"{tmp_path}/out", f"{tmp_path}/cp", ONCE, 900).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == out, "hot, and after the restart over and hot"


def test_keyed_counts_need_no_setting_of_the_session(spark, tmp_path, other_state_store):
    for half in (0, 1):
        event = spark.createDataFrame([(datetime(2024, 1, 1, half), 1, "a", "get")], "timestamp timestamp, object_id long, node_id string, operation string")
        silver_of(spark, event, tmp_path, half)
    assert tables.read_silver(spark, f"{tmp_path}/silver").count() == 2

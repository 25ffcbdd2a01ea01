"""Scripted streams, and the life of a model."""

from datetime import datetime, timezone

import pytest
from frames import rows
from pyspark.sql import functions as F

from edgelake.operators import labels, model
from edgelake.operators.features import build_features
from edgelake.schemas import FEATURE_COLS, GOLD, SILVER, TARGET_COL
from edgelake.sources import events, logs, tables
from edgelake.streaming import jobs

ONCE = {"availableNow": True}


def message(minute, key=1, node=1, operation="get"):
    ms = int(datetime(2024, 1, 1, minute // 60, minute % 60, tzinfo=timezone.utc).timestamp() * 1000)
    return (str(key), f'{{"timestamp_rel":0,"timestamp_abs":{ms},"key":{key},"node_id":{node},"operation":"{operation}"}}')


class Feed:
    """Files of messages, one per batch, and the silver stream over them."""

    def __init__(self, spark, root, sink):
        self.spark, self.root, self.sink, self.n = spark, root, sink, 0

    def send(self, *messages):
        self.n += 1
        df = self.spark.createDataFrame(list(messages), "key string, value string").coalesce(1)
        df.write.mode("append").parquet(f"{self.root}/in")
        source = events.parse_events(events.read_messages(self.spark, "parquet", f"{self.root}/in"))
        jobs.start_silver(source, self.sink, f"{self.root}/cp", ONCE).awaitTermination()


def test_a_new_checkpoint_adds_to_the_store(spark, tmp_path):
    root = str(tmp_path)
    for run, minutes in enumerate([(1, 16), (31, 46)]):
        feed = Feed(spark, f"{root}/{run}", jobs.SilverSink(f"{root}/silver"))
        feed.send(*[message(m) for m in minutes])
    got = rows(tables.read_silver(spark, f"{root}/silver"), "window_index", "req_count_current", "req_count_previous")
    b = base()
    assert got == [(b, 1, 0), (b + 1, 1, 0), (b + 2, 1, 1), (b + 3, 1, 0)]


def test_a_stream_goes_on_after_a_time_no_calendar_has(spark, tmp_path):
    root = str(tmp_path)
    feed = Feed(spark, root, jobs.SilverSink(f"{root}/silver"))
    bad = ("1", '{"timestamp_rel":0,"timestamp_abs":9223372036854775807,"key":1,"node_id":1,"operation":"get"}')
    feed.send(message(1), bad)
    feed.send(message(16))
    assert rows(tables.read_silver(spark, f"{root}/silver"), "window_index") == [(base(),), (base() + 1,)]


def base():
    return int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()) // 900


def test_late_rows_update_open_windows_and_then_are_dropped(spark, tmp_path):
    root = str(tmp_path)
    feed = Feed(spark, root, jobs.SilverSink(f"{root}/silver"))
    feed.send(message(1), message(16))
    feed.send(message(2), message(50))
    feed.send(message(3), message(20), message(36))
    got = rows(tables.read_silver(spark, f"{root}/silver"), "window_index", "req_count_current")
    assert got == [(base(), 2), (base() + 1, 1), (base() + 2, 1), (base() + 3, 1)]


def test_previous_counts_come_from_earlier_batches(spark, tmp_path):
    root, sent = str(tmp_path), []
    sink = jobs.SilverSink(f"{root}/silver", publish=lambda df: sent.extend(map(tuple, df.collect())))
    feed = Feed(spark, root, sink)
    feed.send(message(1), message(2), message(3, operation="put"), message(16))
    feed.send(message(31), message(17))
    got = rows(tables.read_silver(spark, f"{root}/silver"), "window_index", "req_count_current", "req_count_previous", "growth_rate")
    b = base()
    # window b+1 arrived with b in the first batch (no history), and again later, when b was stored
    assert got == [(b, 2, 0, 2.0), (b + 1, 2, 2, 0.0), (b + 2, 1, 1, 0.0)]
    assert [k for k, _ in sent] == ["1"] * 4
    assert all('"growth_rate"' in value for _, value in sent)


def test_batch_and_stream_agree_when_the_batch_is_included(spark, tmp_path):
    root = str(tmp_path)
    feed = Feed(spark, root, jobs.SilverSink(f"{root}/silver", include_batch=True))
    data = [message(m, key=m % 3, node=m % 5) for m in range(0, 120, 2)]
    feed.send(*data)
    requests = events.parse_events(spark.createDataFrame(data, "key string, value string")).withColumnRenamed("timestamp", "ts")
    assert rows(tables.read_silver(spark, f"{root}/silver")) == rows(build_features(requests))


def test_follow_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("a b c d 30\nshort\n")
    stream = logs.follow_simple_log(spark, str(folder), 25)
    stream.writeStream.format("memory").queryName("followed").trigger(**ONCE).start().awaitTermination()
    assert rows(spark.table("followed")) == [(30, 5)]


def gold(spark, n=400):
    i = F.col("id")
    df = spark.range(n).select((i / 20).cast("long").alias("window_index"), (i % 20 * 1000).alias("curr_object_id"), (i * 7 % 11).alias("req_count_current"))
    for field in GOLD.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(0).cast(field.dataType))
    return df.withColumn(TARGET_COL, (F.col("req_count_current") >= 8).cast("int")).select(*GOLD.fieldNames())


@pytest.mark.parametrize("n", [1, 2, 5, 20, 399, 400])
def test_split_is_the_tail(spark, n):
    got = rows(model.chronological_split(gold(spark, n)), "window_index", "curr_object_id", "is_test")
    test = -(-n // 5)
    assert [r[2] for r in got] == [0] * (n - test) + [1] * test


def test_split_of_nothing(spark):
    assert model.chronological_split(gold(spark, 0)).count() == 0


def test_model_life(spark, tmp_path):
    path = str(tmp_path / "models")
    assert model.latest_version(spark, path) is None
    assert model.retrain(spark, gold(spark).withColumn(TARGET_COL, F.lit(0)), path, rounds=3) is None
    assert model.retrain(spark, gold(spark), path, rounds=20, min_f1=1.1) is None
    assert model.retrain(spark, gold(spark), path, rounds=20, min_f1=0.0) == 1
    assert model.retrain(spark, gold(spark), path, rounds=20, min_f1=0.0) == 2
    scored = model.score(gold(spark), model.load_model(spark, path, 2), 0.5)
    report = model.classification_report(scored).first()
    assert report["accuracy"] == 1.0 and report["f1"] == 1.0


def test_scoring_sink_reloads_and_drops_no_batch(spark, tmp_path):
    models, flags = str(tmp_path / "models"), str(tmp_path / "flags")
    at = F.timestamp_seconds(F.lit(1000))
    sink = jobs.ScoringSink(models, flags, threshold=0.5, now=lambda: at)
    batch = gold(spark).select(*SILVER.fieldNames())
    with pytest.raises(RuntimeError, match="no model"):
        sink(batch, 0)
    model.publish_model(model.train_viral(gold(spark), 20), models, 1.0, spark)
    sink(batch, 1)
    assert sink.version == 1
    with pytest.raises(Exception):
        sink(batch.drop(FEATURE_COLS[0]), 2)
    some = batch.withColumn(FEATURE_COLS[0], F.when(F.col("curr_object_id") > 0, F.col(FEATURE_COLS[0])))
    sink(some, 2)
    sink(batch, 1)
    stored = jobs.read_registry(spark, flags, since="1970-01-01")
    assert jobs.read_registry(spark, flags, since="1970-01-02").count() == 0
    want = gold(spark).where(f"{TARGET_COL} = 1").select("curr_object_id").distinct()
    assert rows(stored, "object_id") == rows(want)
    model.publish_model(sink.model, models, 1.0, spark)
    sink(batch, 3)
    assert sink.version == 2
    spark.createDataFrame([(9, 1.0)], "version long, f1 double").write.mode("append").json(f"{models}/versions")
    sink(batch, 4)
    assert sink.version == 2


def test_gold_needs_two_closed_windows(spark):
    one = gold(spark, 40).select(*SILVER.fieldNames())
    assert labels.build_gold(one).count() == 0
    assert labels.build_gold(one.limit(0)).count() == 0
    more = gold(spark, 80).select(*SILVER.fieldNames())
    assert rows(labels.build_gold(more).select("window_index").distinct()) == [(0,), (1,)]


@pytest.mark.parametrize("times, flagged", [(2, [1, 2]), (1, [])])
def test_scoring_with_one_class_of_counts(spark, tmp_path, times, flagged):
    """Every object is asked for as often as any other, so the rule holds for all rows or for none."""
    from __spark_entry__ import queries

    ts = datetime(2024, 1, 3, 12)
    made = [(t * 2 + k, ts, 7 + t, "view", 1.0, f'{{"k": {k}}}') for k in (1, 2) for t in range(times)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["stream_scoring"](spark, str(tmp_path))
    assert rows(got, "object_id", "status") == [(k, "TRUE") for k in flagged]


def test_a_model_below_the_gate_is_trained_once(spark, tmp_path, monkeypatch):
    from edgelake.plans import queries

    trained, train = [], model.train_viral
    monkeypatch.setattr(model, "train_viral", lambda rows, rounds=0, **k: trained.append(1) or train(rows, 2, **k))
    monkeypatch.setattr(queries, "_stored_gold", lambda session, sf: gold(session))
    monkeypatch.setattr(model, "decide", lambda probability, threshold=0.95: F.lit(0))
    got = queries.model_publication(spark, str(tmp_path)).first()
    assert got["gate_held"] and got["test_rows"] > 0
    assert queries.train_and_score(spark, str(tmp_path)).count() == got["test_rows"]
    assert len(trained) == 1

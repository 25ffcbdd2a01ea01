"""Logs, messages and tables."""

import gzip

import pytest
from frames import rows
from pyspark.sql import functions as F

from edgelake.functions.clock import event_time
from edgelake.functions import keys, sketch
from edgelake.operators import features, placement, registry
from edgelake.schemas import SILVER
from edgelake.session import drop_tables
from edgelake.sources import events, logs, tables

# (line, parsed): what the request log rules make of a line that is not the first
LINES = [
    ("12 k1 0 9 31 get", ("k1", 31, "get")),
    ("12,k1,0,9,-3,GET", ("k1", -3, "get")),
    ("  12 , k1  0,9 , 31 , Put , more", ("k1", 31, "put")),
    ("12 k1 0 9 +7 get\t", ("k1", 7, "get")),
    ("12 k1 0 9 31", None),
    ("12,k1,0,9,31,", None),
    ("12,k1,0,9,31, ,", None),
    ("12 k1 0 9 3.5 get", None),
    ("12 k1 0 9 99999999999999999999 get", None),
    ("", None),
    ("   ", None),
    ("x k1 0 9 31 get", ("k1", 31, "get")),
]


def test_request_line_rules(spark):
    lines = spark.createDataFrame([(i + 2, text) for i, (text, _) in enumerate(LINES)], "line_no long, value string")
    want = [(i + 2, *parsed) for i, (_, parsed) in enumerate(LINES) if parsed]
    assert rows(logs.parse_request_lines(lines)) == want


@pytest.mark.parametrize("first, kept", [("time k n m 5 get", False), ("1 k n m 5 get", True)])
def test_first_line(spark, first, kept):
    lines = spark.createDataFrame([(1, first), (2, "x k n m 6 get")], "line_no long, value string")
    assert logs.parse_request_lines(lines).count() == 1 + kept


def test_files_are_numbered_in_one_order(spark, tmp_path):
    for name, n in [("a", 5), ("b", 300)]:
        with gzip.open(tmp_path / f"{name}.log.gz", "wt") as out:
            out.write("h k n m x get\n\n" + "".join(f"{i} k{i} 0 0 {i} get\n" for i in range(3, n + 1)))
    land = str(tmp_path / "landed" / "lines")
    parsed = logs.read_request_log(spark, f"{tmp_path}/*.gz", land)
    assert parsed.where(F.col("file_line") != F.col("node_number")).count() == 0
    assert parsed.groupBy("file").count().count() == 2
    got = rows(parsed, "line_no")
    assert got == [(i,) for i in [*range(3, 6), *range(8, 306)]]
    numbered = features.number_requests(parsed)
    assert rows(numbered, "get_seq") == [(i,) for i in range(1, 302)]
    drop_tables(spark, [land])
    assert not (tmp_path / "landed" / "lines").exists()


def test_series_over_several_files_has_a_sample_per_line(spark, tmp_path):
    for name in "ab":
        with gzip.open(tmp_path / f"{name}.log.gz", "wt") as out:
            out.write("".join(f"{i} k{name}{i % 2} 0 0 {i} get\n" for i in range(1, 6)))
    log = logs.read_request_log(spark, f"{tmp_path}/*.gz").withColumn("object_id", keys.object_id(F.col("object_key")))
    requests = log.withColumn("node_id", F.lit(0))
    nodes = spark.createDataFrame([(0, 10)], "node_id int, capacity int")
    inserts = requests.groupBy("object_id").agg(F.min("line_no").alias("insert_line"))
    series = placement.storage_series(requests, inserts, nodes, 1)
    assert rows(series, "sample", "used") == list(zip(range(1, 11), [1, 2, 2, 2, 2, 3, 4, 4, 4, 4]))


def test_split_files_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"{i} k{i} 0 0 {i} get\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        parsed = logs.read_request_log(spark, str(tmp_path))
        assert parsed.where(F.col("line_no") != F.col("node_number")).count() == 0
        assert parsed.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_simple_lines(spark):
    lines = spark.createDataFrame(
        [(1, "a b c d 26 x"), (2, "a b c d -1"), (3, "a,b c d 5"), (4, "a b c d z")], "line_no long, value string"
    )
    assert rows(logs.parse_simple_lines(lines, 25)) == [(1, 26, 1), (2, -1, 24)]


def test_object_id_of_known_keys(spark):
    import hashlib

    words = ["", "a", "video-1", "żółw", *[f"k{i}" for i in range(100)]]
    df = spark.createDataFrame([(w,) for w in words], "key string")
    got = dict(df.select("key", keys.object_id(F.col("key"))).collect())
    for word in words:
        value = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big", signed=True)
        assert got[word] == value % (2**63 - 1)


def test_hash_vector(spark):
    """Fixed value: bytes 0 to 7 with seed 0."""
    number = int.from_bytes(bytes(range(8)), "little")
    df = spark.range(1).select(sketch.seeded_hash(F.lit(number), 0).alias("h"))
    assert df.first()["h"] == -8626056615231480947


def test_every_seed(spark):
    keys_ = [sketch.seed_key(s) for s in range(40)]
    df = spark.createDataFrame(list(enumerate(keys_)), "seed long, k long")
    assert df.where(F.xxhash64("k") != F.col("seed")).count() == 0


def test_events_round_trip_and_bad_values(spark):
    values = [('{"timestamp_rel":1,"timestamp_abs":1500,"key":5,"node_id":7,"operation":"get"}',), ("oops",), (None,)]
    got = events.parse_events(spark.createDataFrame(values, "value string"))
    found = sorted(map(tuple, got.select(F.unix_millis("timestamp"), "object_id", "node_id", "operation").collect()), key=str)
    assert found == [(1500, 5, "7", "get"), (None, None, None, None)]


def test_feature_messages_without_id(spark):
    messages = spark.createDataFrame([('{"window_index":3,"curr_object_id":9}',), ('{"window_index":3}',), (None,)], "value string")
    assert rows(events.parse_feature_messages(messages), "window_index", "curr_object_id") == [(3, 9)]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(tables.upsert(target, updates, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.upsert(target.limit(0), updates, ["k"])) == [(2, "c"), (3, "d")]


def silver(spark, data):
    df = spark.createDataFrame(data, "window_index long, curr_object_id long, req_count_current long")
    for field in SILVER.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(0).cast(field.dataType))
    return df.select(*SILVER.fieldNames())


def test_silver_store_keeps_the_newest_and_repeats_safely(spark, tmp_path):
    path = str(tmp_path / "silver")
    cols = ["window_index", "curr_object_id", "req_count_current"]
    assert tables.read_silver(spark, path).count() == 0
    tables.append_silver(silver(spark, [(96, 1, 10), (97, 1, 11), (200, 2, 5)]), path, 0)
    for _ in range(2):
        tables.append_silver(silver(spark, [(97, 1, 20), (201, 2, 6)]), path, 1)
    assert rows(tables.read_silver(spark, path), *cols) == [(96, 1, 10), (97, 1, 20), (200, 2, 5), (201, 2, 6)]
    assert rows(tables.read_silver(spark, path, before_version=1), *cols) == [(96, 1, 10), (97, 1, 11), (200, 2, 5)]
    assert rows(tables.read_silver(spark, path, (97, 120)), *cols) == [(97, 1, 20)]
    assert tables.read_silver(spark, path, (5000, 5001)).count() == 0
    assert rows(tables.silver_version(spark, path, 1, (97, 201)), *cols) == [(97, 1, 20), (201, 2, 6)]


def test_versions_grow_over_runs_and_belong_to_a_batch(spark, tmp_path):
    path = str(tmp_path / "silver")
    versions = [tables.batch_version(spark, path, run, batch) for run, batch in [("a", 0), ("a", 1), ("b", 0), ("a", 1), ("b", 0)]]
    assert versions == [1, 2, 3, 2, 3]


def test_compaction_keeps_what_readers_see(spark, tmp_path):
    path = str(tmp_path / "silver")
    cols = ["window_index", "curr_object_id", "req_count_current"]
    for run in range(3):
        version = tables.batch_version(spark, path, "a", run)
        tables.append_silver(silver(spark, [(96 + run, 1, run), (99, 1, run), (300, 2, run)]), path, version)
    before = rows(tables.read_silver(spark, path), *cols)
    assert tables.compact_silver(spark, path, 1, 1) == 4
    assert rows(tables.read_silver(spark, path), *cols) == before
    kept = spark.read.parquet(path).select("window_day", "version").distinct()
    assert rows(kept) == [(1, 4), (3, 1), (3, 2), (3, 3)]
    assert tables.compact_silver(spark, path, 1, 1) is None
    assert tables.batch_version(spark, path, "a", 3) == 5
    assert tables.newest_window(spark, path) == 300
    assert rows(tables.read_recent_silver(spark, path, 5), *cols) == [(300, 2, 2)]


def test_times_outside_the_calendar_are_null(spark):
    ms = [0, 253_402_300_799_999, 253_402_300_800_000, 2**63 - 1, -(2**63), None]
    df = spark.createDataFrame([(x,) for x in ms], "ms long").select("ms", event_time(F.col("ms")).isNull().alias("none"))
    assert {r.ms: r.none for r in df.collect()} == {x: i > 1 for i, x in enumerate(ms)}


def test_read_table_hides_only_absence(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none"), SILVER).schema == SILVER
    with pytest.raises(Exception):
        tables.read_table(spark, str(tmp_path / "none"), SILVER, fmt="no-such-format")


def test_registry_expiry_and_case(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    scores = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "object_id long, prediction int")
    flags = registry.viral_flags(scores, at(1000))
    assert rows(flags, "object_id") == [(1,), (3,)]
    ids = spark.createDataFrame([(1,), (2,), (3,)], "object_id long")
    for second, found in [(999, []), (1000, [(1,), (3,)]), (1899, [(1,), (3,)]), (1900, [])]:
        assert rows(registry.get_viral(ids, flags, at(second))) == found
    again = registry.put_viral(flags, registry.viral_flags(scores.where("object_id = 1"), at(1500)))
    assert rows(registry.get_viral(ids, again, at(2000))) == [(1,)]
    odd = flags.withColumn("status", F.lower("status"))
    assert registry.get_viral(ids, odd, at(1000)).count() == 2
    assert registry.get_viral(ids, odd, at(1000), any_case=False).count() == 0


def test_windows_and_joins_over_a_bucketed_table_do_not_shuffle_it(spark, tmp_path):
    from edgelake.operators.features import add_previous_count

    rows_ = [(w, o, w * o) for w in range(6) for o in range(40) if (w + o) % 5]
    df = spark.createDataFrame(rows_, "window_index long, curr_object_id long, req_count_current long")
    tables.write_bucketed(df, "bucketed_counts", str(tmp_path / "t"), "curr_object_id", 3, ["window_index"])
    table = spark.table("bucketed_counts")
    plan_of = lambda d: d._jdf.queryExecution().executedPlan().toString()
    got = add_previous_count(table)
    assert "Exchange" not in plan_of(got)
    assert rows(got, "window_index", "curr_object_id", "req_count_previous") == rows(
        add_previous_count(df), "window_index", "curr_object_id", "req_count_previous"
    )
    updates = spark.createDataFrame([(1, 2, -1), (9, 9, -2)], df.schema)
    merged = tables.upsert_bucketed("bucketed_counts", updates.hint("merge"), ["window_index", "curr_object_id"])
    left = plan_of(merged).split("Scan parquet")[0]
    assert "Exchange" not in left
    assert rows(merged) == sorted([r for r in rows_ if r[:2] != (1, 2)] + [(1, 2, -1), (9, 9, -2)])
    tables.write_bucketed(df.limit(5), "bucketed_counts", str(tmp_path / "t"), "curr_object_id", 3)
    assert spark.table("bucketed_counts").count() == 5


def test_summaries_merge(spark, tmp_path):
    from edgelake.operators import summaries

    rng = __import__("random").Random(3)
    counts = [(w, o, rng.randrange(1000)) for w in range(96, 96 * 3) for o in range(30)]
    features = spark.createDataFrame(counts, "window_index long, curr_object_id long, req_count_current long")
    asked = [(w * 900 + 5, rng.randrange(50), "get") for w in range(96, 96 * 3) for _ in range(9)]
    requests = spark.createDataFrame(asked, "t long, node_id int, operation string").withColumn("ts", F.timestamp_seconds("t"))
    found = summaries.window_summaries(features, requests)
    summaries.write_summaries(found, str(tmp_path / "s"))
    summaries.write_summaries(found.where("window_index < 192"), str(tmp_path / "s"))
    kept = summaries.read_summaries(spark, str(tmp_path / "s"))
    assert kept.count() == 192 and summaries.read_summaries(spark, str(tmp_path / "s"), (2, 2)).count() == 96
    for r in summaries.merged(kept).collect():
        own = sorted(c for w, _, c in counts if w // 96 == r["window_day"])
        assert (r["windows"], r["objects"]) == (96, 2880) and abs(r["distinct_nodes"] - 50) <= 2
        assert own[int(0.73 * 2880)] <= r["count_floor"] <= own[int(0.77 * 2880)]
    limits = {r["window_index"]: r["p95_limit"] for r in summaries.window_limits(kept).collect()}
    assert all(limits[w] in {c for x, _, c in counts if x == w} for w in limits)
    assert summaries.read_summaries(spark, str(tmp_path / "none")).count() == 0

"""Registered queries and their SQL twins.

Each query takes ``(spark, sf_dir)`` and reads whole tables. Doubles are rounded to 9 digits in both
forms. Queries without SQL hash, sample a sketch, stream or train.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelake.functions import clock, keys, sketch
from edgelake.operators import (
    dedup, features, labels, membership, metrics, model, placement, registry, summaries, topology,
)
from edgelake.operators.scale import prefix_sum
from edgelake.plans import fixtures as fx
from edgelake.plans import oracle_views as ov
from edgelake.schemas import FEATURE_COLS, GOLD, MIN_F1, SILVER, TARGET_COL, WINDOWS_PER_DAY
from edgelake.session import new_table_path, stored
from edgelake.sources import events, growing, logs, publishing, reports, tables
from edgelake.sources.files import place, sizes
from edgelake.streaming import jobs, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ONCE = {"availableNow": True}


def query(oracle: str | None = None, *needs: str):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = ov.sql(oracle, *needs)
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


FEATURE_SELECT = """window_index, hour_of_day, round(hour_sin, 9) AS hour_sin, round(hour_cos, 9) AS hour_cos,
    curr_object_id, active_edges_count, req_count_current, CAST(req_count_previous AS BIGINT) AS req_count_previous,
    round(growth_rate, 9) AS growth_rate"""


# Features


@query(f"SELECT {FEATURE_SELECT} FROM features15", "features15")
def features_with_growth(spark, sf):
    return rounded(fx.features(spark, sf, 900))


@query("SELECT * FROM counts15", "counts15")
def window_counts(spark, sf):
    return features.window_counts(features.get_requests(fx.requests(spark, sf)))


@query()
def window_counts_approx(spark, sf):
    return features.window_counts(features.get_requests(fx.requests(spark, sf)), fx.DAY, exact=False)


BUCKETS = 8


def _bucketed(spark, df):
    path = new_table_path(spark, "bucketed")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    tables.write_bucketed(df, table, path, "curr_object_id", BUCKETS, ["window_index"])
    return table


@query(
    """SELECT window_index, curr_object_id, req_count_current,
      CAST(req_count_previous AS BIGINT) AS req_count_previous FROM features_day""",
    "features_day",
)
def lag_join(spark, sf):
    """Previous counts over a table bucketed by object, which is read without a shuffle."""
    counts = features.window_counts(features.get_requests(fx.requests(spark, sf)), fx.DAY)
    return features.add_previous_count(spark.table(_bucketed(spark, counts))).select(
        "window_index", "curr_object_id", "req_count_current", "req_count_previous"
    )


@query(
    """SELECT line_no, CAST(floor(epoch(ts) / 900) AS BIGINT) AS window_index,
      CAST(floor(epoch(ts) / 3600) AS BIGINT) % 24 AS hour,
      round(sin(2 * pi() * (CAST(floor(epoch(ts) / 3600) AS BIGINT) % 24) / 24), 9) AS hour_sin,
      round(cos(2 * pi() * (CAST(floor(epoch(ts) / 3600) AS BIGINT) % 24) / 24), 9) AS hour_cos
    FROM requests""",
    "requests",
)
def window_and_hour(spark, sf):
    rows = fx.requests(spark, sf).select("line_no", clock.window_index(F.col("ts")).alias("window_index"))
    hour = clock.hour_of_day(F.col("window_index"))
    return rounded(
        rows.withColumn("hour", hour.cast("bigint"))
        .withColumn("hour_sin", clock.hour_sin(F.col("hour")))
        .withColumn("hour_cos", clock.hour_cos(F.col("hour")))
    )


@query(
    f"""SELECT {', '.join(f'round({c}, 9) AS {c}' if c in ('hour_sin', 'hour_cos', 'growth_rate') else
        f'CAST({c} AS BIGINT) AS {c}' if c == 'req_count_previous' else c for c in FEATURE_COLS)} FROM features15""",
    "features15",
)
def feature_vector(spark, sf):
    return rounded(features.feature_vector(fx.features(spark, sf, 900)))


@query(
    """SELECT line_no, row_number() OVER (ORDER BY line_no) AS get_seq FROM gets""",
    "gets",
)
def request_numbers(spark, sf):
    return features.number_requests(fx.requests(spark, sf)).select("line_no", "get_seq")


@query("SELECT line_no, object_id, node_id FROM gets ORDER BY line_no LIMIT 500", "gets")
def first_gets(spark, sf):
    return features.first_lines(fx.requests(spark, sf), max_gets=500).select("line_no", "object_id", "node_id")


@query("SELECT line_no, object_id, node_id FROM gets WHERE line_no <= 700", "gets")
def first_lines(spark, sf):
    return features.first_lines(fx.requests(spark, sf), max_lines=700).select("line_no", "object_id", "node_id")


@query(
    """SELECT line_no, get_seq FROM (SELECT line_no, row_number() OVER (ORDER BY line_no) AS get_seq FROM gets)
    WHERE get_seq % 50 = 0""",
    "gets",
)
def every_nth_get(spark, sf):
    return features.every_nth(fx.requests(spark, sf), 50).select("line_no", "get_seq")


# Logs and messages

PARSED = ov.PARSED.format(lines="lines")


@query(PARSED, "lines")
def parse_request_log(spark, sf):
    return logs.parse_request_lines(fx.request_lines(spark, sf))


@query(
    f"""SELECT line_no, object_key, node_number, operation FROM ({PARSED})""",
    "lines",
)
def read_request_log(spark, sf):
    """The same through packed text files on disk, numbered by the reader."""
    path = new_table_path(spark, "log")
    lines = fx.request_lines(spark, sf)
    _four_files(lines, path)
    return logs.read_request_log(spark, path).select("line_no", "object_key", "node_number", "operation")


def _four_files(lines, path):
    """Packed files that follow each other by name as their lines do."""
    ordered = lines.repartitionByRange(4, "line_no").sortWithinPartitions("line_no")
    ordered.select("value").write.option("compression", "gzip").text(path)


SIMPLE_LINE = "line_no || ' a b  c ' || CASE WHEN line_no % 9 = 4 THEN 'x' ELSE CAST(node_number * 31 AS VARCHAR) END"


@query(
    f"""SELECT line_no, CAST(node_number * 31 AS BIGINT) AS object_id,
      CAST(((node_number * 31) % {fx.N_NODES} + {fx.N_NODES}) % {fx.N_NODES} AS INTEGER) AS node_id
    FROM ({PARSED}) WHERE line_no % 9 <> 4""",
    "lines",
)
def parse_simple_log(spark, sf):
    return logs.parse_simple_lines(_simple_lines(spark, sf), fx.N_NODES)


def _simple_lines(spark, sf):
    parsed = logs.parse_request_lines(fx.request_lines(spark, sf))
    number = F.when(F.col("line_no") % 9 == 4, F.lit("x")).otherwise((F.col("node_number") * 31).cast("string"))
    return parsed.select("line_no", F.concat_ws(" ", "line_no", F.lit("a b  c"), number).alias("value"))


@query(
    f"""SELECT object_id, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT CAST(node_number * 31 AS BIGINT) AS object_id FROM ({PARSED}) WHERE line_no % 9 <> 4) GROUP BY 1""",
    "lines",
)
def follow_simple_log(spark, sf):
    """Counts per object of the lines a stream picked up from a folder."""
    folder, out = new_table_path(spark, "simple"), new_table_path(spark, "followed")
    _simple_lines(spark, sf).select("value").write.text(folder)
    stream = logs.follow_simple_log(spark, folder, fx.N_NODES)
    done = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
    done.trigger(**ONCE).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CAST(object_id AS VARCHAR) AS key, line_no AS timestamp_rel, epoch_us(ts) // 1000 AS timestamp_abs,
      object_id, CAST(node_id AS VARCHAR) AS node_id, operation FROM requests""",
    "requests",
)
def event_messages(spark, sf):
    """Requests as messages, their payload read back by name."""
    messages = events.event_messages(*fx.event_records(spark, sf))
    value = F.from_json("value", "timestamp_rel long, timestamp_abs long, key long, node_id string, operation string")
    return messages.select("key", value.alias("v")).select(
        "key",
        "v.timestamp_rel",
        "v.timestamp_abs",
        F.col("v.key").alias("object_id"),
        "v.node_id",
        "v.operation",
    )


@query(
    """SELECT CASE WHEN line_no % 10 NOT IN (3, 5) THEN (epoch_us(ts) // 1000) * 1000 END AS ts_us,
      CASE WHEN line_no % 10 <> 3 THEN object_id END AS object_id,
      CASE WHEN line_no % 10 <> 3 THEN CAST(node_id AS VARCHAR) END AS node_id,
      CASE WHEN line_no % 10 <> 3 THEN operation END AS operation
    FROM requests WHERE line_no % 10 <> 7""",
    "requests",
)
def parse_events(spark, sf):
    """Messages to bronze rows; some values are broken, some are missing, some have a time no calendar has."""
    rows, rel, absolute = fx.event_records(spark, sf)
    far = F.when(F.col("line_no") % 20 == 5, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))
    messages = events.event_messages(rows, rel, F.when(F.col("line_no") % 10 == 5, far).otherwise(absolute))
    digit = F.regexp_extract("value", r'"timestamp_rel":\d*(\d)', 1)
    values = messages.select(
        "key", F.when(digit == "3", F.lit("{not json")).when(digit != "7", F.col("value")).alias("value")
    )
    bronze = events.parse_events(values)
    return bronze.select(F.unix_micros("timestamp").alias("ts_us"), "object_id", "node_id", "operation")


@query(
    "SELECT operation, CAST(count(*) AS BIGINT) AS n, CAST(sum(object_id) AS BIGINT) AS ids FROM requests GROUP BY 1",
    "requests",
)
def stream_bronze(spark, sf):
    """Bronze table written by a stream over message files."""
    source, out = _message_files(spark, sf), new_table_path(spark, "bronze")
    bronze = events.parse_events(events.read_messages(spark, "parquet", source))
    tables.write_bronze(bronze, out, f"{out}-checkpoint", ONCE).awaitTermination()
    return spark.read.parquet(out).groupBy("operation").agg(
        F.count(F.lit(1)).alias("n"), F.sum("object_id").alias("ids")
    )


def _message_files(spark, sf):
    path = new_table_path(spark, "messages")
    events.event_messages(*fx.event_records(spark, sf)).write.parquet(path)
    return path


@query(f"SELECT CAST(curr_object_id AS VARCHAR) AS key, {FEATURE_SELECT} FROM features15", "features15")
def feature_messages(spark, sf):
    messages = events.feature_messages(fx.features(spark, sf, 900))
    value = F.from_json("value", SILVER).alias("v")
    return rounded(messages.select("key", value).select("key", "v.*"))


@query(f"SELECT {FEATURE_SELECT} FROM features15 WHERE curr_object_id % 4 <> 1", "features15")
def parse_feature_messages(spark, sf):
    """Feature messages back to rows; a quarter of them come without an object id."""
    rows = fx.features(spark, sf, 900)
    no_id = F.when(F.col("curr_object_id") % 4 != 1, F.col("curr_object_id"))
    return rounded(events.parse_feature_messages(events.feature_messages(rows.withColumn("curr_object_id", no_id))))


# Lake tables


@query(
    f"""SELECT {FEATURE_SELECT} FROM (
      SELECT * REPLACE (CASE WHEN window_index % 3 = 0 THEN req_count_current + 100 ELSE req_count_current END
        AS req_count_current) FROM features_day)""",
    "features_day",
)
def upsert_features(spark, sf):
    """Two thirds of the table are there; the other third comes new, or changed for known windows."""
    rows = fx.features(spark, sf)
    target = rows.where((F.col("window_index") % 3 != 0) | (F.col("curr_object_id") % 2 == 0))
    updates = rows.where(F.col("window_index") % 3 == 0).withColumn(
        "req_count_current", F.col("req_count_current") + 100
    )
    return rounded(tables.upsert(target, updates, ["window_index", "curr_object_id"]))


@query(
    f"""SELECT {FEATURE_SELECT} FROM (
      SELECT * REPLACE (CASE WHEN window_index % 3 = 0 THEN req_count_current + 100 ELSE req_count_current END
        AS req_count_current) FROM features_day)""",
    "features_day",
)
def upsert_bucketed(spark, sf):
    """The same into a table bucketed by object."""
    rows = fx.silver(spark, sf)
    name = _bucketed(spark, rows.where((F.col("window_index") % 3 != 0) | (F.col("curr_object_id") % 2 == 0)))
    updates = rows.where(F.col("window_index") % 3 == 0).withColumn("req_count_current", F.col("req_count_current") + 100)
    return rounded(tables.upsert_bucketed(name, updates, ["window_index", "curr_object_id"]))


@query(f"SELECT {FEATURE_SELECT} FROM features_day", "features_day")
def silver_store(spark, sf):
    """The newest version of every row after a first write and a correction of the same keys."""
    path = new_table_path(spark, "silver")
    rows = fx.features(spark, sf)
    tables.append_silver(rows.withColumn("req_count_current", F.lit(-1).cast("bigint")), path, 0)
    tables.append_silver(rows, path, 1)
    return rounded(tables.read_silver(spark, path))


@query(f"SELECT {FEATURE_SELECT}, is_viral_next_window FROM gold", "gold")
def gold_table(spark, sf):
    """Gold written over an older table, and read back."""
    path = new_table_path(spark, "gold")
    rows = labels.build_gold(fx.silver(spark, sf))
    tables.write_table(rows.limit(0), path)
    tables.write_table(rows, path)
    return rounded(tables.read_table(spark, path, GOLD))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM features_day WHERE false", "features_day")
def absent_table(spark, sf):
    """A table that is not there has no rows, also joined with one that is."""
    absent = tables.read_table(spark, new_table_path(spark, "absent"), SILVER)
    return fx.features(spark, sf).join(absent, ["window_index", "curr_object_id"], "left_semi").agg(
        F.count(F.lit(1)).alias("n")
    )


# Keys


@query(
    "SELECT doc_id, d.object_id FROM documents JOIN (SELECT doc_id AS i, CAST(((h % 9223372036854775807) + 9223372036854775807) "
    "% 9223372036854775807 AS BIGINT) AS object_id FROM (SELECT doc_id, CAST(concat('0x', substr(sha256(text), 1, 16)) AS UBIGINT) AS u, "
    "CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE CAST(u AS HUGEINT) END AS h "
    "FROM documents)) d ON d.i = doc_id"
)
def object_key_hash(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", keys.object_id(F.col("text")).alias("object_id"))


@query(
    f"""SELECT event_id, CAST((((user_id - 50) % {fx.N_NODES}) + {fx.N_NODES}) % {fx.N_NODES} AS INTEGER) AS node_id
    FROM events"""
)
def node_routing(spark, sf):
    number = F.col("user_id") - 50
    return fx.table(spark, sf, "events").select("event_id", keys.route(number, fx.N_NODES).alias("node_id"))


@query("SELECT line_no FROM gets", "gets")
def get_filter(spark, sf):
    """GET in any case and with blanks around it."""
    spelled = F.when(F.col("line_no") % 2 == 0, F.upper("operation")).otherwise(F.concat(F.lit(" "), "operation"))
    return features.get_requests(fx.requests(spark, sf).withColumn("operation", spelled)).select("line_no")


# Labels


@query("SELECT min(window_index) AS min_window, max(window_index) AS max_window FROM features15", "features15")
def window_bounds(spark, sf):
    return labels.window_bounds(fx.features(spark, sf, 900))


@query(
    """SELECT CAST(count(DISTINCT window_index) AS BIGINT) AS complete_windows FROM features15
    WHERE window_index < (SELECT max(window_index) FROM features15)""",
    "features15",
)
def complete_windows(spark, sf):
    return labels.complete_windows(fx.features(spark, sf, 900))


@query(
    """SELECT window_index, curr_object_id, req_count_current FROM features15,
      (SELECT max(window_index) AS m FROM features15) WHERE window_index >= m - 96 AND window_index < m""",
    "features15",
)
def lookback_filter(spark, sf):
    return labels.in_lookback(fx.features(spark, sf, 900)).select("window_index", "curr_object_id", "req_count_current")


@query("SELECT CAST(quantile_disc(req_count_current, 0.75) AS BIGINT) AS count_floor FROM features_day", "features_day")
def count_floor(spark, sf):
    return labels.count_floor(fx.features(spark, sf))


@query()
def count_floor_approx(spark, sf):
    return labels.count_floor(fx.features(spark, sf), rel_err=0.05)


@query(
    """SELECT window_index, curr_object_id, p95_limit FROM features_day JOIN (
      SELECT window_index, CAST(quantile_disc(req_count_current, 0.95) AS BIGINT) AS p95_limit
      FROM features_day GROUP BY 1) USING (window_index)""",
    "features_day",
)
def window_limits(spark, sf):
    return labels.add_window_limit(fx.silver(spark, sf)).select("window_index", "curr_object_id", "p95_limit")


@query("SELECT window_index, curr_object_id, req_count_current, is_viral_now FROM labeled", "labeled")
def label_viral(spark, sf):
    return labels.label_viral(fx.silver(spark, sf)).select(
        "window_index", "curr_object_id", "req_count_current", "is_viral_now"
    )


@query(
    """SELECT a.window_index, a.curr_object_id, coalesce(b.is_viral_now, 0) AS is_viral_next_window
    FROM labeled a LEFT JOIN labeled b
      ON b.curr_object_id = a.curr_object_id AND b.window_index = a.window_index + 1""",
    "labeled",
)
def shift_label(spark, sf):
    labeled = labels.label_viral(fx.silver(spark, sf))
    return features.add_next_label(labeled, "is_viral_now", TARGET_COL).select(
        "window_index", "curr_object_id", TARGET_COL
    )


@query(f"SELECT {FEATURE_SELECT}, is_viral_next_window FROM gold", "gold")
def gold_labels(spark, sf):
    return rounded(labels.build_gold(fx.silver(spark, sf)))


@query(f"SELECT {FEATURE_SELECT}, is_viral_next_window FROM gold15", "gold15")
def gold_from_store(spark, sf):
    """Gold of the last day's 15-minute windows, from the silver store; folders of earlier days are not read."""
    path = new_table_path(spark, "silver")
    tables.append_silver(fx.features(spark, sf, 900), path, 1)
    recent = tables.read_recent_silver(spark, path, labels.LOOKBACK_WINDOWS)
    return rounded(labels.build_gold(recent))


RANK_ERROR = 0.02


@query(
    """SELECT window_index // 96 AS window_day, CAST(count(DISTINCT window_index) AS BIGINT) AS windows, CAST(count(*) AS BIGINT) AS objects,
      true AS floor_ok, true AS limits_ok, true AS nodes_ok FROM features15 GROUP BY 1""",
    "features15",
)
def merged_sketches(spark, sf):
    """Days merged from the stored sketches of their windows, held against the rows: ranks within RANK_ERROR, nodes within 5%."""
    path = new_table_path(spark, "summaries")
    rows = stored(fx.features(spark, sf, 900), "features")
    requests = fx.requests(spark, sf)
    summaries.write_summaries(summaries.window_summaries(rows, requests), path)
    kept = summaries.read_summaries(spark, path)
    days = stored(summaries.merged(kept), "days")
    day = F.floor(F.col("window_index") / WINDOWS_PER_DAY).cast("bigint").alias("window_day")

    def within(limit: str, rank: float):
        below = F.avg((F.col("req_count_current") < F.col(limit)).cast("double"))
        upto = F.avg((F.col("req_count_current") <= F.col(limit)).cast("double"))
        return (below <= rank + RANK_ERROR) & (upto >= rank - RANK_ERROR)

    by_day = rows.select(day, "req_count_current").join(days, "window_day").groupBy("window_day").agg(
        within("count_floor", summaries.FLOOR_RANK).alias("floor_ok")
    )
    limits = rows.join(summaries.window_limits(kept), "window_index").groupBy("window_index").agg(
        within("p95_limit", summaries.WINDOW_RANK).alias("ok")
    ).groupBy(day).agg(F.every("ok").alias("limits_ok"))
    exact = features.get_requests(requests).groupBy(
        F.floor(clock.window_index(F.col("ts")) / WINDOWS_PER_DAY).cast("bigint").alias("window_day")
    ).agg(F.count_distinct("node_id").alias("exact"))
    near = F.abs(F.col("distinct_nodes") - F.col("exact")) <= 0.05 * F.col("exact")
    return days.join(by_day, "window_day").join(limits, "window_day").join(exact, "window_day").select(
        "window_day", "windows", "objects", "floor_ok", "limits_ok", near.alias("nodes_ok")
    )


# Registry

def _flag_time():
    """2024-01-20 00:00 UTC."""
    return F.timestamp_seconds(F.lit(1705708800))


@query(
    """SELECT object_id, 'TRUE' AS status, epoch_us(max(scored_at)) AS scored_us,
      epoch_us(max(scored_at)) + 900000000 AS expires_us FROM flags GROUP BY 1""",
    "flags",
)
def put_viral(spark, sf):
    """Registry after all flags: early ones set first, then the later ones over them."""
    return _registry(fx.flags(spark, sf)).select(
        "object_id", "status", F.unix_micros("scored_at").alias("scored_us"),
        F.unix_micros("expires_at").alias("expires_us"),
    )


def _registry(flags):
    scores = flags.withColumn("prediction", F.lit(1))
    early = registry.viral_flags(scores.where(F.col("scored_at") < _flag_time()), F.col("scored_at"))
    late = registry.viral_flags(scores.where(F.col("scored_at") >= _flag_time()), F.col("scored_at"))
    return registry.put_viral(early, late)


@query(
    """SELECT DISTINCT object_id FROM gets WHERE object_id IN (
      SELECT object_id FROM flags GROUP BY 1
      HAVING max(scored_at) = (SELECT max(scored_at) FROM flags))""",
    "gets",
    "flags",
)
def get_viral(spark, sf):
    """Requested objects whose flag is alive when the last flags are set."""
    flags = fx.flags(spark, sf)
    stored = _registry(flags)
    at = flags.agg(F.max("scored_at")).scalar()
    ids = features.get_requests(fx.requests(spark, sf)).select("object_id").distinct()
    return registry.get_viral(ids, stored, at)


@query(
    """SELECT object_id, CAST(sum(alive_now) AS BIGINT) AS alive_now, CAST(sum(alive_later) AS BIGINT) AS alive_later FROM (
      SELECT object_id, CAST(max(scored_at) = (SELECT max(scored_at) FROM flags) AS INTEGER) AS alive_now, 0 AS alive_later
      FROM flags GROUP BY 1) GROUP BY 1""",
    "flags",
)
def flag_expiry(spark, sf):
    """Flags alive when the last one is set, and none 900 seconds later."""
    flags = fx.flags(spark, sf)
    stored = _registry(flags)
    last = flags.agg(F.max("scored_at")).scalar()
    now = registry.live_flags(stored, last).withColumn("alive_now", F.lit(1))
    later = registry.live_flags(stored, last + F.make_dt_interval(secs=F.lit(900))).withColumn(
        "alive_later", F.lit(1)
    )
    return (
        stored.select("object_id")
        .join(now, "object_id", "left")
        .join(later, "object_id", "left")
        .select(
            "object_id",
            F.coalesce("alive_now", F.lit(0)).cast("bigint").alias("alive_now"),
            F.coalesce("alive_later", F.lit(0)).cast("bigint").alias("alive_later"),
        )
    )


VIRAL_SQL = f"""SELECT g.*, CAST(EXISTS (SELECT 1 FROM flags f WHERE f.object_id = g.object_id
      AND f.scored_at <= g.ts AND g.ts < f.scored_at + INTERVAL {fx.DAY} SECOND) AS INTEGER) AS viral FROM gets g"""


@query(f"SELECT line_no, object_id, viral FROM ({VIRAL_SQL})", "gets", "flags")
def viral_requests(spark, sf):
    rows = features.get_requests(fx.requests(spark, sf))
    return registry.add_viral_flag(rows, fx.flags(spark, sf), fx.DAY).select("line_no", "object_id", "viral")


# Topology


@query(f"SELECT src, dst, hop FROM all_hops WHERE hop <= {fx.MAX_HOP}", "all_hops")
def hop_distances(spark, sf):
    return fx.hops(spark, sf)


@query("SELECT src, dst, hop FROM all_hops", "all_hops")
def hop_distances_all(spark, sf):
    """All pairs, step by step until no new pair turns up."""
    return fx.hops(spark, sf, None)


@query("SELECT viewer, node_id, hop, capacity FROM neighbors", "neighbors")
def neighborhood(spark, sf):
    return fx.neighbors(spark, sf)


@query(
    """SELECT source, node_id, path[len(path) - 1] AS parent, CAST(len(path) - 1 AS INTEGER) AS hop FROM (
      SELECT path[1] AS source, path[len(path)] AS node_id, min(path) AS path
      FROM paths WHERE len(path) > 1 AND (path[1], path[len(path)], len(path) - 1) IN (SELECT src, dst, hop FROM all_hops)
      GROUP BY 1, 2)""",
    "all_hops",
    "paths",
)
def shortest_path_trees(spark, sf):
    return topology.shortest_path_trees(fx.edges(spark, sf), fx.nodes(spark, sf), 3)


# Placement


@query("SELECT node_id, object_id, insert_line, slot FROM placement", "placement")
def first_touch_placement(spark, sf):
    return placement.first_touch_placement(fx.requests(spark, sf), fx.nodes(spark, sf))


@query(
    """SELECT viewer, object_id, CAST(count(*) AS BIGINT) AS n_holders, CAST(sum(node_id) AS BIGINT) AS holder_sum,
      min(hop) AS min_hop FROM placement JOIN neighbors USING (node_id) GROUP BY 1, 2""",
    "placement",
    "neighbors",
)
def holders(spark, sf):
    found = placement.holders(fx.placement(spark, sf), fx.neighbors(spark, sf))
    return _holder_columns(found)


def _holder_columns(found):
    total = F.aggregate("holders", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return found.select(
        "viewer", "object_id", F.size("holders").cast("bigint").alias("n_holders"), total.alias("holder_sum"), "min_hop"
    )


@query(
    """SELECT viewer, object_id, CAST(count(*) AS BIGINT) AS n_holders, CAST(sum(node_id) AS BIGINT) AS holder_sum,
      min(hop) AS min_hop FROM content JOIN neighbors USING (node_id) WHERE hop = 2 GROUP BY 1, 2""",
    "content",
    "neighbors",
)
def holders_at_hop(spark, sf):
    return _holder_columns(placement.holders(fx.content(spark, sf), fx.neighbors(spark, sf), hop=2))


@query(
    """SELECT p.node_id, p.object_id FROM content p WHERE EXISTS (SELECT 1 FROM neighbors b JOIN content q
      ON q.node_id = b.node_id WHERE b.viewer = p.node_id AND q.object_id = p.object_id)""",
    "content",
    "neighbors",
)
def duplicate_candidates(spark, sf):
    return placement.duplicate_candidates(fx.content(spark, sf), fx.neighbors(spark, sf))


@query(
    """SELECT p.node_id, p.object_id FROM placement p WHERE EXISTS (SELECT 1 FROM neighbors b JOIN placement q
      ON q.node_id = b.node_id WHERE b.viewer = p.node_id AND b.hop = 1 AND q.object_id = p.object_id)""",
    "placement",
    "neighbors",
)
def duplicate_candidates_at_hop(spark, sf):
    return placement.duplicate_candidates(fx.placement(spark, sf), fx.neighbors(spark, sf), hop=1)


@query(
    """SELECT DISTINCT b.viewer, b.node_id FROM content p JOIN neighbors b ON b.viewer = p.node_id
    JOIN content q ON q.node_id = b.node_id AND q.object_id = p.object_id""",
    "content",
    "neighbors",
)
def candidate_holders(spark, sf):
    rows, near = fx.content(spark, sf), fx.neighbors(spark, sf)
    return placement.candidate_holders(placement.duplicate_candidates(rows, near), rows, near)


NEAREST = """SELECT g.line_no, g.object_id, g.node_id,
      CASE WHEN EXISTS (SELECT 1 FROM {p} p WHERE p.node_id = g.node_id AND p.object_id = g.object_id {own}) THEN 0
        ELSE coalesce((SELECT min(b.hop) FROM neighbors b JOIN {p} q ON q.node_id = b.node_id
          WHERE b.viewer = g.node_id AND q.object_id = g.object_id {near}), {cloud}) END AS distance
    FROM gets g"""
ASOF = NEAREST.format(
    p="placement", own="AND p.insert_line < g.line_no", near="AND q.insert_line < g.line_no", cloud=fx.CLOUD_HOP
)


@query(NEAREST.format(p="placement", own="", near="", cloud=fx.CLOUD_HOP), "gets", "placement", "neighbors")
def nearest_replica(spark, sf):
    rows = features.get_requests(fx.requests(spark, sf)).select("line_no", "object_id", "node_id")
    return placement.nearest_replica(rows, fx.placement(spark, sf), fx.neighbors(spark, sf), fx.CLOUD_HOP)


@query(
    NEAREST.format(p="placement", own="", near="AND b.node_id % 4 <> 0", cloud=fx.CLOUD_HOP),
    "gets",
    "placement",
    "neighbors",
)
def nearest_replica_excluding(spark, sf):
    rows = features.get_requests(fx.requests(spark, sf)).select("line_no", "object_id", "node_id")
    passed_over = fx.nodes(spark, sf).where("node_id % 4 = 0")
    return placement.nearest_replica(
        rows, fx.placement(spark, sf), fx.neighbors(spark, sf), fx.CLOUD_HOP, exclude=passed_over
    )


@query(ASOF, "gets", "placement", "neighbors")
def nearest_replica_asof(spark, sf):
    return _measured(spark, sf).select("line_no", "object_id", "node_id", "distance")


def _measured(spark, sf, stored=None):
    rows = features.get_requests(fx.requests(spark, sf))
    stored = stored or fx.placement(spark, sf)
    return placement.nearest_replica_asof(rows, stored, fx.neighbors(spark, sf), fx.CLOUD_HOP)


@query(
    """SELECT DISTINCT p.object_id FROM placement p WHERE p.node_id = 7 AND p.object_id IN (
      SELECT object_id FROM placement WHERE node_id = 8)""",
    "placement",
)
def common_objects(spark, sf):
    rows = fx.placement(spark, sf)
    return placement.common_objects(rows, 7, rows.where("node_id = 8"))


@query(
    "SELECT node_id, object_id FROM placement UNION SELECT node_id, object_id FROM gets",
    "placement",
    "gets",
)
def insert_absent(spark, sf):
    wanted = features.get_requests(fx.requests(spark, sf)).select("node_id", "object_id")
    return placement.insert_absent(fx.placement(spark, sf), wanted)


@query(
    """SELECT p.node_id, p.object_id FROM placement p WHERE (p.node_id, p.object_id) NOT IN (
      SELECT node_id, object_id FROM requests WHERE operation = 'error')""",
    "placement",
    "requests",
)
def delete_rows(spark, sf):
    gone = fx.requests(spark, sf).where("operation = 'error'")
    return placement.delete_rows(fx.placement(spark, sf).select("node_id", "object_id"), gone)


@query(
    """SELECT node_id, CAST(used AS BIGINT) AS used, capacity, round(utilization, 9) AS utilization FROM used""",
    "used",
)
def storage_utilization(spark, sf):
    return rounded(placement.storage_utilization(fx.placement(spark, sf), fx.nodes(spark, sf)))


@query("SELECT node_id FROM turns", "turns")
def over_limit(spark, sf):
    return placement.over_limit(fx.placement(spark, sf), fx.nodes(spark, sf), fx.LIMIT).select("node_id")


SERIES = """SELECT CAST(get_seq // 50 AS BIGINT) AS sample, CAST(used AS BIGINT) AS used,
      CAST((used * 1000000) // (SELECT sum(capacity) FROM nodes) AS BIGINT) AS sample_millionths FROM (
      SELECT get_seq, (SELECT count(*) FROM placement WHERE insert_line <= line_no) AS used FROM (
        SELECT line_no, row_number() OVER (ORDER BY line_no) AS get_seq FROM gets)) WHERE get_seq % 50 = 0"""


def _series(spark, sf, stored=None):
    stored = stored or fx.placement(spark, sf)
    return placement.storage_series(fx.requests(spark, sf), stored, fx.nodes(spark, sf), 50)


@query(SERIES, "gets", "placement", "nodes")
def storage_series(spark, sf):
    return _series(spark, sf)


@query(
    f"SELECT round(avg(sample_millionths) / 1000000, 9) AS avg_storage_utilization FROM ({SERIES})",
    "gets",
    "placement",
    "nodes",
)
def average_utilization(spark, sf):
    return rounded(placement.average_utilization(_series(spark, sf)))


# Metrics

FULL = f"""SELECT m.line_no, m.object_id, m.node_id, m.distance, v.viral,
      CAST(m.distance >= {fx.CLOUD_HOP} AND EXISTS (SELECT 1 FROM requests e WHERE e.operation = 'error'
        AND e.object_id = m.object_id AND m.line_no - e.line_no > 0 AND m.line_no - e.line_no <= {fx.THRASH_LINES})
        AS INTEGER) AS thrash
    FROM ({ASOF}) m JOIN ({VIRAL_SQL}) v USING (line_no)"""
FULL_NEEDS = ("gets", "placement", "neighbors", "requests", "flags")


def _full(spark, sf, stored=None):
    flagged = registry.add_viral_flag(_measured(spark, sf, stored), fx.flags(spark, sf), fx.DAY)
    return metrics.mark_thrashing(flagged, fx.evictions(spark, sf), fx.THRASH_LINES, fx.CLOUD_HOP)


@query(
    f"""SELECT line_no, distance, CAST(distance = 0 AS INTEGER) AS is_local_hit,
      CAST(distance > 0 AND distance <= {fx.EDGE_MAX_HOP} AS INTEGER) AS is_neighbor_hit,
      CAST(distance <= {fx.EDGE_MAX_HOP} AS INTEGER) AS is_edge_hit,
      CAST(distance >= {fx.CLOUD_HOP} AS INTEGER) AS is_cloud FROM ({ASOF})""",
    "gets",
    "placement",
    "neighbors",
)
def hit_classes(spark, sf):
    return metrics.classify_hits(_measured(spark, sf), fx.EDGE_MAX_HOP, fx.CLOUD_HOP).select(
        "line_no", "distance", "is_local_hit", "is_neighbor_hit", "is_edge_hit", "is_cloud"
    )


@query(
    f"""SELECT g.line_no, g.object_id, CAST(EXISTS (SELECT 1 FROM requests e WHERE e.operation = 'error'
        AND e.object_id = g.object_id AND g.line_no - e.line_no > 0 AND g.line_no - e.line_no <= {fx.THRASH_LINES})
        AS INTEGER) AS thrash FROM gets g""",
    "gets",
    "requests",
)
def thrash_join(spark, sf):
    """Every GET counted as a cloud request, so that the as-of part alone decides."""
    rows = features.get_requests(fx.requests(spark, sf)).withColumn("distance", F.lit(fx.CLOUD_HOP))
    marked = metrics.mark_thrashing(rows, fx.evictions(spark, sf), fx.THRASH_LINES, fx.CLOUD_HOP)
    return marked.select("line_no", "object_id", "thrash")


METRICS = f"""SELECT CAST(count(*) AS BIGINT) AS total_requests,
      CAST(count(*) FILTER (distance <= {fx.EDGE_MAX_HOP}) AS BIGINT) AS edge_hit_requests,
      CAST(count(*) FILTER (distance = 0) AS BIGINT) AS local_hit_requests,
      CAST(count(*) FILTER (distance > 0 AND distance <= {fx.EDGE_MAX_HOP}) AS BIGINT) AS neighbor_hit_requests,
      CAST(count(*) FILTER (distance >= {fx.CLOUD_HOP}) AS BIGINT) AS cloud_requests,
      CAST(sum(distance) AS BIGINT) AS total_latency, CAST(sum(viral) AS BIGINT) AS viral_requests,
      CAST(sum(viral * distance) AS BIGINT) AS viral_latency_sum,
      CAST(count(*) FILTER (viral = 1 AND distance >= {fx.CLOUD_HOP}) AS BIGINT) AS viral_cloud_requests,
      CAST(sum(thrash) AS BIGINT) AS cache_thrashing_count,
      round(count(*) FILTER (distance <= {fx.EDGE_MAX_HOP}) / count(*), 9) AS edge_hit_ratio,
      round(count(*) FILTER (distance >= {fx.CLOUD_HOP}) / count(*), 9) AS cloud_backhaul_ratio,
      round(sum(distance) / count(*), 9) AS avg_latency,
      round(coalesce(sum(viral * distance) / nullif(sum(viral), 0), 0), 9) AS avg_viral_latency
    FROM ({FULL})"""


def _metrics(spark, sf, stored=None):
    return metrics.request_metrics(_full(spark, sf, stored), fx.EDGE_MAX_HOP, fx.CLOUD_HOP)


@query(METRICS, *FULL_NEEDS)
def request_metrics(spark, sf):
    return rounded(_metrics(spark, sf))


USE = f"(SELECT avg(sample_millionths) / 1000000 FROM ({SERIES}))"
EFFICIENCY = f"""count(*) FILTER (distance <= {fx.EDGE_MAX_HOP}) / count(*) / {USE}"""


@query(
    f"""SELECT round({USE}, 9) AS avg_storage_utilization, round({EFFICIENCY}, 9) AS dedup_efficiency_score
    FROM ({ASOF})""",
    "gets",
    "placement",
    "neighbors",
    "nodes",
)
def dedup_efficiency(spark, sf):
    stored = fx.placement(spark, sf)
    measured = _measured(spark, sf, stored).withColumn("viral", F.lit(0)).withColumn("thrash", F.lit(0))
    totals = metrics.request_metrics(measured, fx.EDGE_MAX_HOP, fx.CLOUD_HOP)
    use = placement.average_utilization(_series(spark, sf, stored))
    return rounded(
        metrics.dedup_efficiency(totals, use).select("avg_storage_utilization", "dedup_efficiency_score")
    )


@query(
    f"""SELECT round(sum(coalesce(l, 0)) / count(*), 9) AS avg_latency FROM nodes LEFT JOIN (
      SELECT node_id, avg(distance) AS l FROM ({ASOF}) GROUP BY 1) USING (node_id)""",
    "gets",
    "placement",
    "neighbors",
    "nodes",
)
def node_mean_latency(spark, sf):
    return rounded(metrics.node_mean_latency(_measured(spark, sf), fx.nodes(spark, sf)))


LONG = {
    "totalRequests": "count(*)",
    "edgeHitRatio": f"count(*) FILTER (distance <= {fx.EDGE_MAX_HOP}) / count(*)",
    "localHitRequests": "count(*) FILTER (distance = 0)",
    "neighborHitRequests": f"count(*) FILTER (distance > 0 AND distance <= {fx.EDGE_MAX_HOP})",
    "cloudRequests": f"count(*) FILTER (distance >= {fx.CLOUD_HOP})",
    "cloudBackhaulRatio": f"count(*) FILTER (distance >= {fx.CLOUD_HOP}) / count(*)",
    "avgLatency": "sum(distance) / count(*)",
    "viralRequests": "sum(viral)",
    "avgViralLatency": "coalesce(sum(viral * distance) / nullif(sum(viral), 0), 0)",
    "viralCloudRequests": f"count(*) FILTER (viral = 1 AND distance >= {fx.CLOUD_HOP})",
    "evictedFiles": "(SELECT count(*) FROM sweep WHERE dropped)",
    "evictedViralFiles": "(SELECT count(*) FROM sweep WHERE dropped AND object_id IN (SELECT object_id FROM hot))",
    "cacheThrashingCount": "sum(thrash)",
    "avgStorageUtilization": USE,
    "dedupEfficiencyScore": EFFICIENCY,
}


@query(
    "SELECT metric, round(CAST(value AS DOUBLE), 9) AS value FROM (UNPIVOT (SELECT "
    + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in LONG.items())
    + f" FROM ({FULL})) ON COLUMNS(*) INTO NAME metric VALUE value)",
    *FULL_NEEDS,
    "nodes",
    "sweep",
    "hot",
)
def metrics_report(spark, sf):
    """The report of a run, written as CSV and read back."""
    rows, near, hosts = fx.placement(spark, sf), fx.neighbors(spark, sf), fx.nodes(spark, sf)
    gone = dedup.dedup_basic(rows, near, hosts, fx.LIMIT)
    log = dedup.eviction_log(rows, placement.delete_rows(rows, gone), 0, fx.hot_objects(spark, sf))
    use = placement.average_utilization(_series(spark, sf, rows))
    totals = metrics.dedup_efficiency(_metrics(spark, sf, rows), use)
    path = new_table_path(spark, "report")
    reports.write_metrics_csv(metrics.run_metrics(totals, dedup.eviction_counts(log)), path)
    return rounded(spark.read.csv(path, header=True, schema="metric string, value double"))


# Dedup


@query("SELECT node_id, object_id, CAST(permitted AS INTEGER) AS permitted FROM permission", "permission")
def delete_permission(spark, sf):
    return dedup.delete_permission(fx.placement(spark, sf), fx.neighbors(spark, sf))


@query(
    f"SELECT node_id, object_id, CAST(permitted AS INTEGER) AS permitted FROM ({ov.permission_sql('content')})",
    "content",
    "neighbors",
)
def delete_permission_content(spark, sf):
    return dedup.delete_permission(fx.content(spark, sf), fx.neighbors(spark, sf))


def _sweep(spark, sf, protect=True):
    viral = fx.hot_objects(spark, sf) if protect else None
    return dedup.sweep_plan(fx.placement(spark, sf), fx.neighbors(spark, sf), fx.nodes(spark, sf), fx.LIMIT, viral)


@query("SELECT s AS node_id, object_id FROM sweep WHERE dropped", "sweep")
def dedup_basic(spark, sf):
    return dedup.dedup_basic(fx.placement(spark, sf), fx.neighbors(spark, sf), fx.nodes(spark, sf), fx.LIMIT)


@query(
    """SELECT s AS node_id, object_id, CAST(candidate AS INTEGER) AS candidate, CAST(permitted AS INTEGER) AS permitted,
      CAST(permitted AND NOT dropped AS INTEGER) AS protected, CAST(dropped AS INTEGER) AS dropped
    FROM guarded_sweep WHERE candidate""",
    "guarded_sweep",
)
def viral_protection(spark, sf):
    """The sweep with the flagged objects kept; candidates only."""
    return _sweep(spark, sf).where("candidate = 1").select(
        "node_id", "object_id", "candidate", "permitted", "protected", "dropped"
    )


@query(
    """SELECT s AS node_id, object_id, CAST(9999 AS BIGINT) AS line_no,
      CAST(object_id IN (SELECT object_id FROM hot) AS INTEGER) AS viral FROM sweep WHERE dropped""",
    "sweep",
    "hot",
)
def eviction_log(spark, sf):
    rows = fx.placement(spark, sf)
    gone = dedup.dedup_basic(rows, fx.neighbors(spark, sf), fx.nodes(spark, sf), fx.LIMIT)
    return dedup.eviction_log(rows, placement.delete_rows(rows, gone), 9999, fx.hot_objects(spark, sf))


@query(
    """SELECT adds, deletes, round(deletes / adds, 9) AS dedup_rate, CAST(0 AS DOUBLE) AS false_delete_rate FROM (
      SELECT (SELECT CAST(count(*) AS BIGINT) FROM placement) AS adds,
        (SELECT CAST(count(*) AS BIGINT) FROM sweep WHERE dropped) AS deletes)""",
    "placement",
    "sweep",
)
def dedup_rates(spark, sf):
    rows = fx.placement(spark, sf)
    gone = dedup.dedup_basic(rows, fx.neighbors(spark, sf), fx.nodes(spark, sf), fx.LIMIT)
    return rounded(metrics.dedup_rates(rows, gone))


@query(
    """SELECT t.node_id, CAST(coalesce(c.packs, 0) AS BIGINT) AS packs, CAST(coalesce(h.hops, 0) AS BIGINT) AS trans_hops
    FROM turns t LEFT JOIN (SELECT s, count(*) AS packs FROM sweep WHERE candidate GROUP BY 1) c ON c.s = t.node_id
    LEFT JOIN (SELECT viewer, sum(hop) AS hops FROM neighbors GROUP BY 1) h ON h.viewer = t.node_id""",
    "turns",
    "sweep",
    "neighbors",
)
def message_overhead(spark, sf):
    rows, near, hosts = fx.placement(spark, sf), fx.neighbors(spark, sf), fx.nodes(spark, sf)
    plan = dedup.sweep_plan(rows, near, hosts, fx.LIMIT)
    return dedup.message_overhead(plan, near, placement.over_limit(rows, hosts, fx.LIMIT))


INITIATOR = 3


def latency_views(source: str, initiator: int = INITIATOR) -> str:
    """Permitted copies near the initiator of objects it holds, with the summed hops of its group."""
    return f"""SELECT p.object_id, p.node_id, q.permitted,
        (SELECT CAST(sum(hop) AS BIGINT) FROM all_hops WHERE dst = p.node_id AND (src = {initiator} OR src IN (
          SELECT node_id FROM neighbors WHERE viewer = {initiator}))) AS total_hop
    FROM {source} p JOIN neighbors b ON b.viewer = {initiator} AND b.node_id = p.node_id
    JOIN ({ov.permission_sql(source)}) q ON q.node_id = p.node_id AND q.object_id = p.object_id
    WHERE p.object_id IN (SELECT object_id FROM {source} WHERE node_id = {initiator})"""


def victims(source: str, initiator: int = INITIATOR) -> str:
    return f"""SELECT object_id, node_id FROM (SELECT *, row_number() OVER (
        PARTITION BY object_id ORDER BY total_hop DESC, node_id DESC) AS r FROM ({latency_views(source, initiator)}) WHERE permitted)
      WHERE r = 1"""


def _latency_inputs(spark, sf):
    """Nodes of one neighbourhood are at most twice its radius apart, so farther hops are not needed."""
    hops = fx.hops(spark, sf, 2 * fx.MAX_HOP)
    return fx.placement(spark, sf), fx.neighbors(spark, sf, hops), hops


@query(
    f"""SELECT object_id, node_id, CAST(permitted AS INTEGER) AS permitted, total_hop
    FROM ({latency_views('placement')})""",
    "placement",
    "neighbors",
    "all_hops",
)
def latency_permissions(spark, sf):
    found = dedup.latency_permissions(*_latency_inputs(spark, sf), INITIATOR)
    return found.withColumn("permitted", F.col("permitted").cast("int"))


@query(victims("placement"), "placement", "neighbors", "all_hops")
def victim_choice(spark, sf):
    return dedup.choose_victims(dedup.latency_permissions(*_latency_inputs(spark, sf), INITIATOR))


@query(
    f"""SELECT node_id, object_id FROM ({victims('placement')}) WHERE object_id NOT IN (SELECT object_id FROM hot)""",
    "placement",
    "neighbors",
    "all_hops",
    "hot",
)
def dedup_latency(spark, sf):
    return dedup.dedup_latency(*_latency_inputs(spark, sf), INITIATOR, fx.hot_objects(spark, sf))


def _after_turn(before: str, initiator: int, spared: str) -> str:
    """Placement after the turn of an initiator, unchanged when that is below the limit; spared objects stay."""
    return f"""SELECT node_id, object_id FROM {before} WHERE NOT (
        (SELECT count(*) FROM {before} WHERE node_id = {initiator}) / (SELECT capacity FROM nodes WHERE node_id = {initiator})
          >= {fx.LIMIT} AND object_id NOT IN (SELECT object_id FROM {spared})
          AND (object_id, node_id) IN ({victims(before, initiator)}))"""


for _kind, _spared in (("pass", "nobody"), ("guarded", "hot")):
    for _node in range(fx.N_NODES):
        _before = f"{_kind}{_node - 1}" if _node else "placement"
        ov.view(f"{_kind}{_node}", _after_turn(_before, _node, _spared), _before, "nodes", "neighbors", "all_hops", _spared)


def _latency_sweep(spark, sf, viral=None):
    rows, near, hops = _latency_inputs(spark, sf)
    return dedup.latency_sweep(rows, near, hops, fx.nodes(spark, sf), fx.LIMIT, range(fx.N_NODES), viral)


@query(f"SELECT node_id, object_id FROM guarded{fx.N_NODES - 1}", f"guarded{fx.N_NODES - 1}")
def dedup_latency_sweep(spark, sf):
    """Every node in turn, flagged objects kept; later ones see what earlier ones dropped."""
    return _latency_sweep(spark, sf, fx.hot_objects(spark, sf)).placement


@query(f"SELECT node_id, object_id FROM pass{fx.N_NODES - 1}", f"pass{fx.N_NODES - 1}")
def dedup_latency_sweep_all(spark, sf):
    """Every node in turn; later ones see what earlier ones dropped."""
    return _latency_sweep(spark, sf).placement


@query(
    "SELECT turn, node_id, used, open FROM (" + " UNION ALL ".join(
        f"""SELECT CAST({n} AS INTEGER) AS turn, CAST({n} AS INTEGER) AS node_id, count(*) AS used,
          count(*) / (SELECT capacity FROM nodes WHERE node_id = {n}) >= {fx.LIMIT} AS open
        FROM {f'pass{n - 1}' if n else 'placement'} WHERE node_id = {n}"""
        for n in range(fx.N_NODES)
    ) + ")",
    f"pass{fx.N_NODES - 1}",
)
def dedup_latency_gates(spark, sf):
    """What every node holds when its turn comes, and whether that opens the turn."""
    return _latency_sweep(spark, sf).gates


@query(
    f"""SELECT CAST(count(DISTINCT l.object_id) + count(*) AS BIGINT) AS packs,
      CAST((SELECT sum(b.hop + o.onward) FROM neighbors b JOIN (
          SELECT viewer, sum(hop) AS onward FROM neighbors GROUP BY 1) o ON o.viewer = b.node_id
        WHERE b.viewer = {INITIATOR} AND b.node_id IN (SELECT node_id FROM ({latency_views('placement')}))) AS BIGINT)
        AS trans_hops
    FROM ({latency_views('placement')}) l""",
    "placement",
    "neighbors",
    "all_hops",
)
def latency_overhead(spark, sf):
    rows, near, hops = _latency_inputs(spark, sf)
    return dedup.latency_overhead(dedup.latency_permissions(rows, near, hops, INITIATOR), near, INITIATOR)


# Replay of a log


def replay_log(spark, sf):
    """From packed log files to hits, backhaul, use of the caches and a sweep, as totals of one replay."""
    path = new_table_path(spark, "log")
    _four_files(fx.request_lines(spark, sf), path)
    parsed = logs.read_request_log(spark, path).select(
        "line_no",
        keys.object_id(F.col("object_key")).alias("object_id"),
        keys.route(F.col("node_number"), fx.N_NODES).alias("node_id"),
        "operation",
    )
    requests, hosts, near = stored(parsed, "requests"), fx.nodes(spark, sf), fx.neighbors(spark, sf)
    held = stored(placement.first_touch_placement(requests, hosts), "placement")
    measured = placement.nearest_replica_asof(features.get_requests(requests), held, near, fx.CLOUD_HOP)
    evicted = requests.where("operation = 'error'").select("object_id", "line_no")
    marked = metrics.mark_thrashing(measured.withColumn("viral", F.lit(0)), evicted, fx.THRASH_LINES, fx.CLOUD_HOP)
    totals = metrics.request_metrics(marked, fx.EDGE_MAX_HOP, fx.CLOUD_HOP).select(
        "total_requests", "local_hit_requests", "neighbor_hit_requests", "cloud_requests", "total_latency", "cache_thrashing_count"
    )
    series = placement.storage_series(requests, held, hosts, 50)
    drops = dedup.dedup_basic(held, near, hosts, fx.LIMIT)
    return totals.select(
        "*",
        series.agg(F.coalesce(F.sum("used"), F.lit(0))).scalar().alias("used_in_samples"),
        drops.agg(F.count(F.lit(1))).scalar().alias("dropped_copies"),
    )


QUERIES["replay_log"] = replay_log
ORACLES["replay_log"] = ov.over_lines(ov.sql(
    f"""SELECT CAST(count(*) AS BIGINT) AS total_requests,
      CAST(count(*) FILTER (distance = 0) AS BIGINT) AS local_hit_requests,
      CAST(count(*) FILTER (distance > 0 AND distance <= {fx.EDGE_MAX_HOP}) AS BIGINT) AS neighbor_hit_requests,
      CAST(count(*) FILTER (distance >= {fx.CLOUD_HOP}) AS BIGINT) AS cloud_requests,
      CAST(coalesce(sum(distance), 0) AS BIGINT) AS total_latency,
      CAST(count(*) FILTER (distance >= {fx.CLOUD_HOP} AND EXISTS (SELECT 1 FROM requests e WHERE e.operation = 'error'
        AND e.object_id = m.object_id AND m.line_no - e.line_no > 0 AND m.line_no - e.line_no <= {fx.THRASH_LINES}))
        AS BIGINT) AS cache_thrashing_count,
      (SELECT CAST(coalesce(sum(used), 0) AS BIGINT) FROM ({SERIES})) AS used_in_samples,
      (SELECT count(*) FROM sweep WHERE dropped) AS dropped_copies
    FROM ({ASOF}) m""",
    "gets", "placement", "neighbors", "requests", "nodes", "sweep",
))


# Model


@query(
    """SELECT window_index, curr_object_id, is_viral_next_window FROM gold
    WHERE curr_object_id % 5 <> 0 AND window_index % 7 <> 3""",
    "gold",
)
def training_rows(spark, sf):
    """Gold rows complete in all inputs and the label; some of both are taken out first."""
    gold = labels.build_gold(fx.silver(spark, sf))
    growth = F.when(F.col("curr_object_id") % 5 != 0, F.col("growth_rate"))
    label = F.when(F.col("window_index") % 7 != 3, F.col(TARGET_COL))
    return model.training_rows(gold.withColumn("growth_rate", growth).withColumn(TARGET_COL, label)).select(
        "window_index", "curr_object_id", TARGET_COL
    )


@query(
    """SELECT window_index, curr_object_id, CAST(row_number() OVER (ORDER BY window_index, curr_object_id)
      > (SELECT count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM gold) AS INTEGER) AS is_test FROM gold""",
    "gold",
)
def chronological_split(spark, sf):
    rows = model.chronological_split(model.training_rows(_stored_gold(spark, sf)))
    return rows.select("window_index", "curr_object_id", "is_test")


@query(
    """SELECT CAST(count(*) FILTER (is_viral_next_window = 0) AS BIGINT) AS negatives,
      CAST(count(*) FILTER (is_viral_next_window = 1) AS BIGINT) AS positives,
      round(count(*) FILTER (is_viral_next_window = 0) / greatest(count(*) FILTER (is_viral_next_window = 1), 1) * 0.7, 9)
        AS positive_weight FROM gold""",
    "gold",
)
def class_balance(spark, sf):
    return rounded(model.class_balance(labels.build_gold(fx.silver(spark, sf))))


@query(
    """SELECT n, tp, fp, fn, round((n - fp - fn) / n, 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1
    FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (p = 1 AND y = 1) AS BIGINT) AS tp,
        CAST(count(*) FILTER (p = 1 AND y = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (p = 0 AND y = 1) AS BIGINT) AS fn
      FROM (SELECT is_viral_next_window AS y, CAST(least(req_count_current / 5.0, 1.0) >= 0.95 AS INTEGER) AS p FROM gold))""",
    "gold",
)
def classification_report(spark, sf):
    """A simple score, the request count over five, judged at the threshold."""
    gold = labels.build_gold(fx.silver(spark, sf))
    share = F.least(F.col("req_count_current") / 5.0, F.lit(1.0))
    return rounded(model.classification_report(gold.withColumn("prediction", model.decide(share))))


_published: dict[tuple[str, str], str] = {}


def _stored_gold(spark, sf):
    path = new_table_path(spark, "gold")
    tables.write_table(labels.build_gold(fx.silver(spark, sf)), path)
    return tables.read_table(spark, path, GOLD)


def _models(spark, sf):
    """Folder of the model that ``retrain`` makes of gold with the published settings; made once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _published:
        path = new_table_path(spark, "models")
        trained, f1 = model.train_and_judge(_stored_gold(spark, sf))
        if model.publish_model(trained, path, f1, spark) is None:
            # Below the gate nothing is published; what was trained is then stored under the version it would have.
            trained.write().overwrite().save(f"{path}/version=1")
        _published[key] = path
    return _published[key]


@query()
def train_and_score(spark, sf):
    """Scores of the held-out rows by a model trained on the others: 200 rounds, threshold 0.95."""
    split = model.chronological_split(model.training_rows(_stored_gold(spark, sf)))
    return model.score(split.where("is_test = 1"), model.load_model(spark, _models(spark, sf), 1))


@query(
    """SELECT CAST(count(*) FILTER (WHERE NOT is_test) AS BIGINT) AS train_rows,
      CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS test_rows,
      CAST(count(*) FILTER (WHERE NOT is_test AND is_viral_next_window = 1) AS BIGINT) AS positives,
      round(CAST(count(*) FILTER (WHERE NOT is_test AND is_viral_next_window = 0) AS DOUBLE)
        / greatest(count(*) FILTER (WHERE NOT is_test AND is_viral_next_window = 1), 1) * 0.7, 9) AS positive_weight,
      true AS gate_held
    FROM (SELECT *, row_number() OVER (ORDER BY window_index, curr_object_id)
        > count(*) OVER () - CAST(ceil(count(*) OVER () * 0.2) AS BIGINT) AS is_test FROM gold)""",
    "gold",
)
def model_publication(spark, sf):
    """What a model was trained on, and whether it was published exactly if its F1 is 0.4 or more."""
    split = model.chronological_split(model.training_rows(_stored_gold(spark, sf)))
    train, test = split.where("is_test = 0"), split.where("is_test = 1")
    path = _models(spark, sf)
    f1 = model.classification_report(model.score(test, model.load_model(spark, path, 1))).first()["f1"]
    version = model.latest_version(spark, path)
    balance = model.class_balance(train)
    return rounded(balance.select(
        (F.col("negatives") + F.col("positives")).alias("train_rows"),
        F.lit(test.count()).cast("bigint").alias("test_rows"),
        "positives",
        "positive_weight",
        F.lit((version is not None) == (f1 >= MIN_F1)).alias("gate_held"),
    ))


# Membership


N_BITS, N_HASHES = 1 << 14, 5
CBF = (N_BITS, N_HASHES)


@query(
    f"""SELECT object_id, s.seed, {ov.signed('h')} AS h FROM (SELECT object_id, seed, {ov.XX_RESULT} AS h FROM (
      SELECT object_id, seed, {ov.xx_steps('object_id', 'seed')}
      FROM (SELECT DISTINCT object_id FROM content), (SELECT unnest(range(24)) AS seed))) s""",
    "content",
)
def seeded_hash(spark, sf):
    ids = fx.content(spark, sf).select("object_id").distinct()
    hashes = F.array(*[
        F.struct(F.lit(s).cast("bigint").alias("seed"), sketch.seeded_hash(F.col("object_id"), s).alias("h"))
        for s in range(24)
    ])
    return ids.select("object_id", F.explode(hashes).alias("x")).select("object_id", "x.*")


@query("SELECT object_id, i, pos FROM positions", "positions")
def bloom_positions(spark, sf):
    ids = fx.content(spark, sf).select("object_id").distinct()
    return ids.select(
        "object_id", F.posexplode(sketch.bloom_positions(F.col("object_id"), *CBF)).alias("i", "pos")
    ).withColumn("i", F.col("i").cast("bigint"))


@query(
    """SELECT node_id, CAST(ceil(-ln(1.0 / capacity) / (ln(2) * ln(2))) AS BIGINT) AS bits,
      CAST(round(ceil(-ln(1.0 / capacity) / (ln(2) * ln(2))) * ln(2)) AS BIGINT) AS hashes FROM nodes""",
    "nodes",
)
def bloom_sizing(spark, sf):
    """Bits per entry and hash functions for one false hit in ``capacity``, node by node."""
    bits = sketch.bloom_bits_per_entry(1 / F.col("capacity"))
    return fx.nodes(spark, sf).select("node_id", bits.alias("bits"), sketch.bloom_hash_count(bits).alias("hashes"))


CBF_SQL = """SELECT node_id, pos, CAST(count(*) AS BIGINT) AS cnt FROM content JOIN positions USING (object_id)
    GROUP BY 1, 2"""


@query(CBF_SQL, "content", "positions")
def cbf_build(spark, sf):
    return membership.cbf_build(fx.content(spark, sf), ["node_id"], "object_id", *CBF)


@query(
    "SELECT pos, CAST(count(*) AS BIGINT) AS cnt FROM content JOIN positions USING (object_id) GROUP BY 1",
    "content",
    "positions",
)
def cbf_merge(spark, sf):
    """Filters of even and of odd nodes added up."""
    rows = fx.content(spark, sf)
    even = membership.cbf_build(rows.where("node_id % 2 = 0"), [], "object_id", *CBF)
    odd = membership.cbf_build(rows.where("node_id % 2 = 1"), [], "object_id", *CBF)
    return membership.cbf_merge(even, odd)


@query(
    """SELECT node_id, object_id FROM (
      SELECT p.node_id, p.object_id, d.pos FROM (
        SELECT node_id, object_id FROM content UNION SELECT (node_id + 1) % 20, object_id FROM content) p
      JOIN (SELECT DISTINCT object_id, pos FROM positions) d USING (object_id))
    LEFT JOIN (SELECT DISTINCT node_id, pos, 1 AS is_set FROM content JOIN positions USING (object_id)) USING (node_id, pos)
    GROUP BY node_id, object_id HAVING count(*) = count(is_set)""",
    "content",
    "positions",
)
def cbf_semi_join(spark, sf):
    """Members and as many others against the filter of a node: members are found, and others by false hits."""
    rows = fx.content(spark, sf)
    others = rows.select(F.pmod(F.col("node_id") + 1, F.lit(20)).alias("node_id"), "object_id")
    cbf = membership.cbf_build(rows, ["node_id"], "object_id", *CBF)
    return membership.cbf_semi_join(rows.union(others).distinct(), cbf, ["node_id"], "object_id", *CBF)


@query(
    f"""SELECT node_id, pos, CAST(count(*) AS BIGINT) AS cnt FROM content JOIN positions USING (object_id)
    WHERE object_id % 3 <> 0 GROUP BY 1, 2""",
    "content",
    "positions",
)
def cbf_delete(spark, sf):
    rows = fx.content(spark, sf)
    cbf = membership.cbf_build(rows, ["node_id"], "object_id", *CBF)
    return membership.cbf_delete(cbf, rows.where("object_id % 3 = 0"), ["node_id"], "object_id", *CBF)


QF_BITS = 40
QF_SQL = f"""SELECT c.node_id, h & {(1 << QF_BITS) - 1} AS fp, CAST(count(*) AS BIGINT) AS cnt
    FROM content c JOIN hashes USING (object_id)"""


@query(f"{QF_SQL} GROUP BY 1, 2", "content", "hashes")
def qf_build(spark, sf):
    return membership.qf_build(fx.content(spark, sf), ["node_id"], "object_id", QF_BITS)


@query("SELECT node_id, object_id FROM content WHERE object_id % 2 = 0", "content")
def qf_semi_join(spark, sf):
    """Probes with all members against filters of half of them; 40 bits tell all of them apart here."""
    rows = fx.content(spark, sf)
    qf = membership.qf_build(rows.where("object_id % 2 = 0"), ["node_id"], "object_id", QF_BITS)
    return membership.qf_semi_join(rows, qf, ["node_id"], "object_id", QF_BITS)


@query(f"{QF_SQL} WHERE object_id % 3 <> 0 GROUP BY 1, 2", "content", "hashes")
def qf_delete(spark, sf):
    rows = fx.content(spark, sf)
    qf = membership.qf_build(rows, ["node_id"], "object_id", QF_BITS)
    return membership.qf_delete(qf, rows.where("object_id % 3 = 0"), ["node_id"], "object_id", QF_BITS)


TREE_RATE = 1e-9


@query(
    """SELECT kind, viewer, hop, node_id, volume, CAST(ceil((ln(volume) - ln(1e-9)) / ln(2)) AS INTEGER) AS bits FROM (
      SELECT 'leaf' AS kind, viewer, hop, node_id, CAST(capacity AS BIGINT) AS volume FROM neighbors
      UNION ALL SELECT 'level', viewer, hop, NULL, CAST(sum(capacity) AS BIGINT) FROM neighbors GROUP BY viewer, hop
      UNION ALL SELECT 'root', viewer, NULL, NULL, CAST(sum(capacity) AS BIGINT) FROM neighbors GROUP BY viewer)""",
    "neighbors",
)
def fingerprint_sizing(spark, sf):
    return membership.tree_sizes(fx.neighbors(spark, sf), TREE_RATE)


@query(
    """SELECT 'leaf' AS kind, viewer, hop, node_id, pos, CAST(count(*) AS BIGINT) AS cnt
      FROM placement JOIN neighbors USING (node_id) JOIN place_positions USING (object_id) GROUP BY ALL
    UNION ALL SELECT 'level', viewer, hop, NULL, pos, CAST(count(*) AS BIGINT)
      FROM placement JOIN neighbors USING (node_id) JOIN place_positions USING (object_id) GROUP BY viewer, hop, pos
    UNION ALL SELECT 'root', viewer, NULL, NULL, pos, CAST(count(*) AS BIGINT)
      FROM placement JOIN neighbors USING (node_id) JOIN place_positions USING (object_id) GROUP BY viewer, pos""",
    "placement",
    "neighbors",
    "place_positions",
)
def index_tree_cbf(spark, sf):
    tree = membership.cbf_tree(fx.placement(spark, sf), fx.neighbors(spark, sf), *CBF)
    none = F.lit(None).cast("int")
    rows = None
    for kind, cols in membership.LEVELS.items():
        part = tree[kind].select(
            F.lit(kind).alias("kind"),
            "viewer",
            (F.col("hop") if "hop" in cols else none).alias("hop"),
            (F.col("node_id") if "node_id" in cols else none).alias("node_id"),
            "pos",
            "cnt",
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


HELD = """SELECT viewer, object_id, hop, node_id FROM content JOIN neighbors USING (node_id)
    WHERE (viewer, object_id) IN (SELECT node_id, object_id FROM content)"""


@query(HELD, "content", "neighbors")
def index_tree_search(spark, sf):
    """Fingerprint trees at one false hit in 10^9 name the true holders of every own object."""
    rows, near = fx.content(spark, sf), fx.neighbors(spark, sf)
    tree = membership.qf_tree(rows, near, TREE_RATE)
    return membership.qf_tree_search(rows.withColumnRenamed("node_id", "viewer"), tree, near, TREE_RATE)


@query(
    """SELECT viewer, object_id, hop, node_id FROM (
      SELECT p.node_id AS viewer, p.object_id, b.hop, b.node_id, d.pos FROM content p
      JOIN neighbors b ON b.viewer = p.node_id
      JOIN (SELECT DISTINCT object_id, pos FROM positions) d ON d.object_id = p.object_id)
    LEFT JOIN (SELECT DISTINCT node_id, pos, 1 AS is_set FROM content JOIN positions USING (object_id)) USING (node_id, pos)
    GROUP BY viewer, object_id, hop, node_id HAVING count(*) = count(is_set)""",
    "content",
    "neighbors",
    "positions",
)
def index_tree_search_cbf(spark, sf):
    rows, near = fx.content(spark, sf), fx.neighbors(spark, sf)
    tree = membership.cbf_tree(rows, near, *CBF)
    return membership.cbf_tree_search(rows.withColumnRenamed("node_id", "viewer"), tree, near, *CBF)


def _negatives(spark, sf):
    """Objects no node holds: documents by id instead of by text."""
    number = F.concat(F.lit("doc-"), F.col("doc_id"))
    return fx.table(spark, sf, "documents").select(keys.object_id(number).alias("object_id"))


def _rate_sql(cols: list[str], held: str, negatives: str = "small_negatives") -> str:
    """Share of negatives found by every filter; one is a false hit where no position of it is missing."""
    return f"""SELECT {', '.join(f'f.{c}' for c in cols)}, count(*) FILTER (missed = 0) / count(*) AS fpr FROM (
          SELECT {', '.join(f'f.{c}' for c in cols)}, n.object_id, count(*) - count(t.pos) AS missed
          FROM (SELECT DISTINCT {', '.join(cols)} FROM neighbors) f CROSS JOIN {negatives} n
          LEFT JOIN (SELECT DISTINCT {', '.join(cols)}, pos FROM {held} JOIN neighbors USING (node_id)) t
            ON {' AND '.join(f't.{c} = f.{c}' for c in cols)} AND t.pos = n.pos
          GROUP BY ALL) f GROUP BY ALL"""


def _fpr_sql() -> str:
    parts = {kind: _rate_sql(cols, "small_content") for kind, cols in membership.LEVELS.items()}
    return f"""SELECT viewer, round(r, 9) AS root_fpr, round(level, 9) AS level_fpr, round((leaf + r + level) / 3, 9) AS all_fpr
    FROM (SELECT viewer, r, (levels + r) / (n + 1) AS level, leaf
      FROM (SELECT viewer, fpr AS r FROM ({parts['root']}))
      JOIN (SELECT viewer, sum(fpr) AS levels, count(*) AS n FROM ({parts['level']}) GROUP BY 1) USING (viewer)
      JOIN (SELECT viewer, avg(fpr) AS leaf FROM ({parts['leaf']}) GROUP BY 1) USING (viewer))"""


@query(_fpr_sql(), "small_negatives", "small_content", "neighbors")
def false_positive_rates(spark, sf):
    near = fx.neighbors(spark, sf)
    tree = membership.cbf_tree(fx.content(spark, sf), near, 1 << 10, 3)
    return rounded(membership.cbf_tree_fpr(_negatives(spark, sf), tree, near, 1 << 10, 3))


def _sizes_sql(source: str, entry: str) -> str:
    """Filters, entries and bytes of the trees; ``entry`` names what an entry is for, ``{bits}`` the bits of its filter."""
    parts = []
    for keys in (["viewer"], ["viewer", "hop"], ["viewer", "hop", "node_id"]):
        names = ", ".join(keys)
        bits = f"""(SELECT {names}, CAST(ceil((ln(sum(capacity)) - ln({TREE_RATE})) / ln(2)) AS BIGINT) AS bits
          FROM neighbors GROUP BY {names})"""
        parts.append(f"""SELECT {names.replace('viewer', 'b.viewer', 1)}, count(DISTINCT {entry}) AS n
          FROM (SELECT viewer, hop, node_id FROM neighbors) b JOIN {source} USING (node_id) JOIN {bits} USING ({names})
          GROUP BY {names.replace('viewer', 'b.viewer', 1)}""")
    union = " UNION ALL ".join(f"SELECT viewer, n FROM ({part})" for part in parts)
    return f"""SELECT viewer, CAST(count(*) AS BIGINT) AS filters, CAST(sum(n) AS BIGINT) AS entries,
      CAST(sum(n) * 16 AS BIGINT) AS bytes FROM ({union}) GROUP BY viewer"""


CBF_SIZES = _sizes_sql("(SELECT node_id, pos FROM placement JOIN place_positions USING (object_id))", "pos")


@query(CBF_SIZES, "neighbors", "placement", "place_positions")
def sketch_bits_cbf(spark, sf):
    """What the counting filters of the trees take as tables."""
    return membership.stored_sizes(membership.cbf_tree(fx.placement(spark, sf), fx.neighbors(spark, sf), *CBF))


@query(
    _sizes_sql("(SELECT node_id, h FROM placement JOIN place_hashes USING (object_id))", "h & ((CAST(1 AS BIGINT) << bits) - 1)"),
    "neighbors",
    "placement",
    "place_hashes",
)
def sketch_bits_qf(spark, sf):
    """What the fingerprint filters of the trees take as tables."""
    return membership.stored_sizes(membership.qf_tree(fx.placement(spark, sf), fx.neighbors(spark, sf), TREE_RATE))


@query(
    f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM sweep WHERE dropped) AS deletes,
      round((SELECT count(*) FROM sweep WHERE dropped) / (SELECT count(*) FROM placement), 9) AS dedup_rate,
      CAST(0 AS DOUBLE) AS false_delete_rate,
      (SELECT CAST(coalesce(sum(hop), 0) AS BIGINT) FROM neighbors WHERE viewer IN (SELECT node_id FROM turns)) AS overhead,
      (SELECT CAST(count(*) AS BIGINT) FROM sweep WHERE candidate) AS packs,
      (SELECT round(sum(coalesce(l, 0)) / count(*), 9) FROM nodes LEFT JOIN (
        SELECT node_id, avg(distance) AS l FROM ({ASOF}) GROUP BY 1) USING (node_id)) AS average_latency,
      (SELECT CAST(count(DISTINCT viewer) AS INTEGER) FROM neighbors) AS fpr_entries,
      (SELECT round(sum(fpr), 9) FROM ({_rate_sql(['viewer'], 'placed_positions', 'large_negatives')})) AS fpr_total,
      (SELECT CAST(sum(bytes) * 8 AS BIGINT) FROM ({CBF_SIZES})) AS memory_bits""",
    "gets",
    "placement",
    "neighbors",
    "nodes",
    "turns",
    "sweep",
    "large_negatives",
    "placed_positions",
    "place_positions",
)
def run_summary(spark, sf):
    """The summary of a run, written as JSON and read back; its lists as their length and sum."""
    rows, near, hosts = fx.placement(spark, sf), fx.neighbors(spark, sf), fx.nodes(spark, sf)
    plan = dedup.sweep_plan(rows, near, hosts, fx.LIMIT)
    overhead = dedup.message_overhead(plan, near, placement.over_limit(rows, hosts, fx.LIMIT))
    counters = metrics.dedup_rates(rows, plan.where("dropped = 1")).select(
        F.col("deletes"),
        F.col("dedup_rate"),
        F.col("false_delete_rate"),
        overhead.agg(F.coalesce(F.sum("trans_hops"), F.lit(0))).scalar().alias("overhead"),
        overhead.agg(F.coalesce(F.sum("packs"), F.lit(0))).scalar().alias("packs"),
    )
    tree = membership.cbf_tree(rows, near, *CBF)
    rates = membership.cbf_tree_fpr(_negatives(spark, sf), tree, near, *CBF).select("viewer", F.col("root_fpr").alias("fpr"))
    memory = membership.stored_sizes(tree).select("viewer", (F.col("bytes") * 8).alias("bits"))
    summary = reports.run_summary(counters, rates, memory, metrics.node_mean_latency(_measured(spark, sf, rows), hosts))
    path = new_table_path(spark, "summary")
    reports.write_run_json(summary, path)
    stored = spark.read.json(path, schema=summary.schema)
    total = F.aggregate("memory", F.lit(0).cast("bigint"), lambda a, b: a + b)
    rate = F.aggregate("fpr_data", F.lit(0.0), lambda a, b: a + b)
    return rounded(
        stored.withColumns({"fpr_entries": F.size("fpr_data"), "fpr_total": rate, "memory_bits": total}).drop("fpr_data", "memory")
    )


# Streams


def _run(started) -> None:
    started.awaitTermination()


def _bronze_stream(spark, sf):
    return events.parse_events(events.read_messages(spark, "parquet", _message_files(spark, sf)))


@query(f"SELECT {FEATURE_SELECT} FROM features15", "features15")
def stream_silver(spark, sf):
    """Silver store filled by the feature stream, previous counts taken from the batch as well."""
    path = new_table_path(spark, "silver")
    sink = jobs.SilverSink(path, include_batch=True)
    _run(jobs.start_silver(_bronze_stream(spark, sf), sink, f"{path}-checkpoint", ONCE))
    return rounded(tables.read_silver(spark, path))


# 2024-01-16 00:00 UTC, a window boundary.
HALF_MS = 1705363200000


def _feed(spark, sf, folder, chosen):
    """Append the chosen events to a folder of messages, as one file per task."""
    rows, rel, absolute = fx.event_records(spark, sf)
    events.event_messages(rows.where(chosen), rel, absolute).write.mode("append").parquet(folder)


@query(f"SELECT {FEATURE_SELECT} FROM features15", "features15")
def stream_silver_restarted(spark, sf):
    """The same by two streams: the second has a checkpoint of its own, so its batches count from 0 again."""
    root = new_table_path(spark, "restarted")
    at = F.unix_millis("ts")
    for half, chosen in enumerate((at < HALF_MS, at >= HALF_MS)):
        _feed(spark, sf, f"{root}/messages{half}", chosen)
        source = events.parse_events(events.read_messages(spark, "parquet", f"{root}/messages{half}"))
        sink = jobs.SilverSink(f"{root}/silver", include_batch=True)
        _run(jobs.start_silver(source, sink, f"{root}/checkpoint{half}", ONCE))
    return rounded(tables.read_silver(spark, f"{root}/silver"))


@query(f"SELECT {FEATURE_SELECT} FROM features15", "features15")
def silver_compacted(spark, sf):
    """A store of several versions, put into one."""
    path = new_table_path(spark, "silver")
    rows = fx.features(spark, sf, 900)
    for batch_id, part in enumerate((rows.withColumn("req_count_current", F.lit(-1).cast("bigint")), rows)):
        tables.append_silver(part, path, tables.batch_version(spark, path, "run", batch_id))
    first, last = rows.agg(F.min("window_index"), F.max("window_index")).first()
    tables.compact_silver(spark, path, first // WINDOWS_PER_DAY, last // WINDOWS_PER_DAY)
    return rounded(tables.read_silver(spark, path))


LATE = f"""SELECT *, line_no % 10 = 7 AND epoch_ms(ts) < {HALF_MS} AS late FROM gets"""


@query(
    f"""SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) AS window_index, object_id AS curr_object_id,
      CAST(count(*) AS BIGINT) AS req_count_current
    FROM ({LATE}) WHERE NOT late OR (floor(epoch(ts) / 900) + 1) * 900 > (
      SELECT max(epoch_ms(ts)) / 1000 - 900 FROM ({LATE}) WHERE NOT late AND epoch_ms(ts) < {HALF_MS})
    GROUP BY 1, 2""",
    "gets",
)
def stream_late_rows(spark, sf):
    """A tenth of the first half comes with the second: it counts where its window is still open, else it is dropped."""
    root = new_table_path(spark, "late")
    at = F.unix_millis("ts")
    late = (F.col("line_no") % 10 == 7) & (at < HALF_MS)
    for chosen in (~late & (at < HALF_MS), late | (at >= HALF_MS)):
        _feed(spark, sf, f"{root}/messages", chosen)
        source = events.parse_events(events.read_messages(spark, "parquet", f"{root}/messages"))
        _run(jobs.start_silver(source, jobs.SilverSink(f"{root}/silver"), f"{root}/checkpoint", ONCE))
    return tables.read_silver(spark, f"{root}/silver").select("window_index", "curr_object_id", "req_count_current")


@query(
    """SELECT window_index, curr_object_id, req_count_current, CAST(0 AS BIGINT) AS req_count_previous,
      CAST(req_count_current AS DOUBLE) AS growth_rate FROM features15""",
    "features15",
)
def stream_silver_stored_history(spark, sf):
    """The same with previous counts from earlier batches only: a first batch finds none."""
    path = new_table_path(spark, "silver")
    sink = jobs.SilverSink(path)
    _run(jobs.start_silver(_bronze_stream(spark, sf), sink, f"{path}-checkpoint", ONCE))
    return rounded(tables.read_silver(spark, path).select(
        "window_index", "curr_object_id", "req_count_current", "req_count_previous", "growth_rate"
    ))


@query(
    """SELECT 'bronze' AS stage, CAST(count(*) AS BIGINT) AS n FROM requests
    UNION ALL SELECT 'silver', CAST(count(*) AS BIGINT) FROM counts15
    UNION ALL SELECT 'published', CAST(count(*) AS BIGINT) FROM counts15""",
    "requests",
    "counts15",
)
def stream_two_sinks(spark, sf):
    """Bronze and silver from one source, and the messages the silver stream published."""
    root = new_table_path(spark, "lake")
    publish = lambda messages: messages.write.mode("append").parquet(f"{root}/published")
    for started in jobs.start_lake(_bronze_stream(spark, sf), root, publish, ONCE):
        started.awaitTermination()
    parts = [
        ("bronze", spark.read.parquet(f"{root}/bronze")),
        ("silver", tables.read_silver(spark, f"{root}/silver")),
        ("published", spark.read.parquet(f"{root}/published")),
    ]
    rows = None
    for stage, df in parts:
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    """SELECT DISTINCT curr_object_id AS object_id, 'TRUE' AS status, CAST(1705709700000000 AS BIGINT) AS expires_us
    FROM features_day WHERE req_count_current >= 2""",
    "features_day",
)
def stream_scoring(spark, sf):
    """Registry written by the scoring stream over published features, by a model whose rule is a request count.

    The model learns from every row as it is and with counts on either side of the rule, so both classes occur in any table.
    """
    root = new_table_path(spark, "scoring")
    rows = fx.features(spark, sf)
    count = F.col("req_count_current")
    counts = F.explode(F.array(count, F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
    taught = rows.withColumn("req_count_current", counts).withColumn(TARGET_COL, (count >= 2).cast("int"))
    model.publish_model(model.train_viral(taught, 20), f"{root}/models", 1.0, spark)
    events.feature_messages(rows).write.parquet(f"{root}/features")
    parsed = events.parse_feature_messages(events.read_messages(spark, "parquet", f"{root}/features"))
    sink = jobs.ScoringSink(f"{root}/models", f"{root}/registry", threshold=0.5, now=_flag_time)
    _run(jobs.start_scoring(parsed, sink, f"{root}/checkpoint", ONCE))
    return jobs.read_registry(spark, f"{root}/registry", since="2024-01-20").select(
        "object_id", "status", F.unix_micros("expires_at").alias("expires_us")
    )


@query(
    """SELECT object_id, 'TRUE' AS status, epoch_us(max(scored_at)) + 900000000 AS expires_us FROM flags GROUP BY 1""",
    "flags",
)
def registry_restarted(spark, sf):
    """The stored registry after two streams, both with a first batch 0, which is written twice."""
    path = new_table_path(spark, "registry")
    scores = fx.flags(spark, sf).withColumn("prediction", F.lit(1))
    for run, chosen in (("one", F.col("scored_at") < _flag_time()), ("two", F.col("scored_at") >= _flag_time())):
        for _ in range(2):
            version = tables.batch_version(spark, path, run, 0)
            jobs.append_flags(registry.viral_flags(scores.where(chosen), F.col("scored_at")), path, version)
    return jobs.read_registry(spark, path).select("object_id", "status", F.unix_micros("expires_at").alias("expires_us"))


@query(f"SELECT {FEATURE_SELECT} FROM features15", "features15")
def stream_silver_keyed(spark, sf):
    """Silver by keyed state, in two streams; the second has a new checkpoint and starts from the counts the first stored."""
    root = new_table_path(spark, "keyed")
    at = F.unix_millis("ts")
    for half, chosen in enumerate((at < HALF_MS, at >= HALF_MS)):
        _feed(spark, sf, f"{root}/messages{half}", chosen)
        source = events.parse_events(events.read_messages(spark, "parquet", f"{root}/messages{half}"))
        _run(stateful.start_keyed_silver(source, f"{root}/silver", f"{root}/checkpoint{half}", ONCE))
    return rounded(tables.read_silver(spark, f"{root}/silver"))


FLAG_TTL = fx.DAY + 900


@query(
    f"""SELECT object_id, at_ms, change FROM (
      WITH marked AS (SELECT object_id, epoch_ms(scored_at) AS t,
          CASE WHEN epoch_ms(scored_at) < {FLAG_TTL * 1000} + lag(epoch_ms(scored_at)) OVER (PARTITION BY object_id ORDER BY scored_at)
            THEN 0 ELSE 1 END AS new FROM flags),
        lives AS (SELECT object_id, min(t) AS since, max(t) + {FLAG_TTL * 1000} AS until FROM (
          SELECT *, sum(new) OVER (PARTITION BY object_id ORDER BY t) AS life FROM marked) GROUP BY object_id, life)
      SELECT object_id, since AS at_ms, 'hot' AS change FROM lives
      UNION ALL SELECT object_id, until, 'over' FROM lives WHERE until < (SELECT max(t) FROM marked))""",
    "flags",
)
def stream_flag_expiry(spark, sf):
    """When objects become hot and when that is over, told by a stream of flags that is stopped and restarted half way."""
    root = new_table_path(spark, "flags")
    flags = fx.flags(spark, sf)
    for chosen in (F.col("scored_at") < _flag_time(), F.col("scored_at") >= _flag_time()):
        flags.where(chosen).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema("object_id bigint, scored_at timestamp").parquet(f"{root}/in")
        _run(stateful.start_flag_changes(source, f"{root}/out", f"{root}/checkpoint", ONCE, FLAG_TTL))
    return spark.read.parquet(f"{root}/out")


@query(
    f"""SELECT object_id, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT CAST(node_number * 31 AS BIGINT) AS object_id FROM ({PARSED}) WHERE line_no % 9 <> 4) GROUP BY 1""",
    "lines",
)
def follow_growing_log(spark, sf):
    """Counts per object of a log that grows between three runs of one stream; a run finds the last line unfinished."""
    root = new_table_path(spark, "growing")
    _simple_lines(spark, sf).select("value").coalesce(1).write.text(f"{root}/whole")
    system, folder = place(root)
    system.create_dir(f"{folder}/logs", recursive=True)
    (name, size), = [(f, n) for f, n in sizes(system, f"{folder}/whole").items()]
    for upto in (size // 3, size // 2, size):
        with system.open_input_file(name) as whole, system.open_output_stream(f"{folder}/logs/requests.log") as log:
            for at in range(0, upto, 1 << 20):
                log.write(whole.read_at(min(1 << 20, upto - at), at))
        stream = growing.follow_growing_log(spark, f"{root}/logs", fx.N_NODES, taskBytes=str(1 << 16))
        done = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
        _run(done.trigger(**ONCE).start(f"{root}/out"))
    return spark.read.parquet(f"{root}/out").groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST(curr_object_id AS VARCHAR) AS key, {FEATURE_SELECT} FROM features15", "features15")
def stream_published_features(spark, sf):
    """Feature messages published once per batch by a stream and read back, after the last batch was tried again."""
    root = new_table_path(spark, "published")
    sink = jobs.SilverSink(f"{root}/silver", include_batch=True, published=f"{root}/topic")
    _run(jobs.start_silver(_bronze_stream(spark, sf), sink, f"{root}/checkpoint", ONCE))
    version = tables.next_version(spark, f"{root}/silver") - 1
    again = events.feature_messages(tables.read_silver(spark, f"{root}/silver"))
    publishing.publish_once(again, f"{root}/topic", f"version-{version}")
    value = F.from_json("value", SILVER).alias("v")
    return rounded(publishing.read_published(spark, f"{root}/topic").select("key", value).select("key", "v.*"))

"""Traffic features per object and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelake.functions.clock import hour_cos, hour_of_day, hour_sin, window_index
from edgelake.functions.keys import is_get
from edgelake.functions.traffic import growth_rate
from edgelake.operators.scale import prefix_sum
from edgelake.schemas import FEATURE_COLS, SILVER, SILVER_KEYS, WINDOW_SECONDS


def get_requests(requests: DataFrame) -> DataFrame:
    return requests.where(is_get(F.col("operation")))


def window_counts(requests: DataFrame, seconds: int = WINDOW_SECONDS, exact: bool = True) -> DataFrame:
    """Requests and distinct nodes per (tumbling window, object) of rows ``(ts, object_id, node_id)``.

    The exact count goes through one row per (window, object, node), made before the shuffle, so a
    hot object costs at most one row per node and window. The other form keeps a HyperLogLog sketch.
    """
    rows = requests.select(
        window_index(F.col("ts"), seconds).alias("window_index"),
        F.col("object_id").alias("curr_object_id"),
        "node_id",
    )
    if not exact:
        return rows.groupBy(*SILVER_KEYS).agg(
            F.approx_count_distinct("node_id").alias("active_edges_count"),
            F.count(F.lit(1)).alias("req_count_current"),
        )
    per_node = rows.groupBy(*SILVER_KEYS, "node_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_node.groupBy(*SILVER_KEYS).agg(
        F.count("node_id").alias("active_edges_count"), F.sum("_n").alias("req_count_current")
    )


def add_hour_features(counts: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    hour = F.col("hour_of_day")
    return (
        counts.withColumn("hour_of_day", hour_of_day(F.col("window_index"), seconds))
        .withColumn("hour_sin", hour_sin(hour))
        .withColumn("hour_cos", hour_cos(hour))
    )


def _neighbour_window(value: str, step: int) -> Column:
    """``value`` of the same object exactly ``step`` windows away, NULL where there is no such window.

    One shuffle by object serves it, and an object has one row per window; a self join on shifted
    window numbers would shuffle the table twice.
    """
    by_object = Window.partitionBy("curr_object_id").orderBy("window_index")
    frame = by_object.rangeBetween(step, step)
    return F.max(value).over(frame)


def add_previous_count(features: DataFrame) -> DataFrame:
    """``req_count_previous`` of the window before (0 when there is none), and ``growth_rate``."""
    previous = F.coalesce(_neighbour_window("req_count_current", -1), F.lit(0)).cast("bigint")
    return features.withColumn("req_count_previous", previous).withColumn(
        "growth_rate", growth_rate(F.col("req_count_current"), F.col("req_count_previous"))
    )


def add_next_label(labeled: DataFrame, label: str, out: str, ahead: int = 1) -> DataFrame:
    """The label ``ahead`` windows later, 0 when the object is not seen then."""
    return labeled.withColumn(out, F.coalesce(_neighbour_window(label, ahead), F.lit(0)).cast("int"))


def join_previous_count(batch: DataFrame, history: DataFrame) -> DataFrame:
    """``add_previous_count`` against a stored table, which a row of the batch itself never changes."""
    previous = history.select(
        (F.col("window_index") + 1).alias("window_index"),
        "curr_object_id",
        F.col("req_count_current").alias("req_count_previous"),
    )
    joined = batch.join(previous, SILVER_KEYS, "left").fillna({"req_count_previous": 0})
    return joined.withColumn(
        "growth_rate", growth_rate(F.col("req_count_current"), F.col("req_count_previous"))
    ).select(*SILVER.fieldNames())


def build_features(requests: DataFrame, seconds: int = WINDOW_SECONDS, exact: bool = True) -> DataFrame:
    """Requests to the whole silver table."""
    counts = window_counts(get_requests(requests), seconds, exact)
    return add_previous_count(add_hour_features(counts, seconds)).select(*SILVER.fieldNames())


def feature_vector(features: DataFrame) -> DataFrame:
    """The model inputs, in training order."""
    return features.select(*FEATURE_COLS)


def number_requests(requests: DataFrame) -> DataFrame:
    """GET requests with ``get_seq``, their number in line order, from 1."""
    return prefix_sum(get_requests(requests), "line_no", {"get_seq": F.lit(1)})


def first_lines(requests: DataFrame, max_lines: int | None = None, max_gets: int | None = None) -> DataFrame:
    """GET requests up to a line, or up to the n-th GET."""
    rows = get_requests(requests)
    if max_lines is not None:
        rows = rows.where(F.col("line_no") <= max_lines)
    if max_gets is not None:
        rows = number_requests(rows).where(F.col("get_seq") <= max_gets).drop("get_seq")
    return rows


def every_nth(requests: DataFrame, n: int) -> DataFrame:
    return number_requests(requests).where(F.col("get_seq") % n == 0)

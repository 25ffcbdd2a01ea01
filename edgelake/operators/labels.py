"""Labels of objects that are about to become popular, and the gold table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.operators.features import add_next_label
from edgelake.operators.scale import lookup_join
from edgelake.schemas import GOLD, TARGET_COL, WINDOWS_PER_DAY

# Quantiles, lookback and horizon of the labels.
WINDOW_QUANTILE = 0.95
FLOOR_QUANTILE = 0.75
LOOKBACK_WINDOWS = WINDOWS_PER_DAY
AHEAD_WINDOWS = 1


def window_bounds(features: DataFrame) -> DataFrame:
    """Smallest and largest window, NULL for an empty table."""
    return features.agg(F.min("window_index").alias("min_window"), F.max("window_index").alias("max_window"))


def max_window(features: DataFrame) -> Column:
    """The largest window as a scalar subquery."""
    return features.agg(F.max("window_index")).scalar()


def complete_windows(features: DataFrame) -> DataFrame:
    """Count of distinct windows below the newest one, which is still open."""
    closed = features.where(F.col("window_index") < max_window(features))
    return closed.select("window_index").distinct().agg(F.count(F.lit(1)).alias("complete_windows"))


def in_lookback(features: DataFrame, lookback: int = LOOKBACK_WINDOWS, newest: int | None = None) -> DataFrame:
    """The ``lookback`` windows below the newest one; with its number given the scan is pruned by it."""
    top = max_window(features) if newest is None else F.lit(newest)
    window = F.col("window_index")
    return features.where((window >= top - lookback) & (window < top))


def quantile(col: str, p: float, rel_err: float = 0.0) -> Column:
    """Discrete quantile, exact unless an error is allowed.

    The exact form counts distinct values before the shuffle; request counts that add up to T have
    at most sqrt(2T) distinct values.
    """
    if rel_err:
        return F.percentile_approx(col, p, int(round(1 / rel_err)))
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})").cast("bigint")


def count_floor(features: DataFrame, rel_err: float = 0.0) -> DataFrame:
    return features.agg(quantile("req_count_current", FLOOR_QUANTILE, rel_err).alias("count_floor"))


def window_limits(features: DataFrame, rel_err: float = 0.0) -> DataFrame:
    """Upper quantile of the counts of every window."""
    return features.groupBy("window_index").agg(
        quantile("req_count_current", WINDOW_QUANTILE, rel_err).alias("p95_limit")
    )


def add_window_limit(features: DataFrame, rel_err: float = 0.0, max_windows: int | None = None) -> DataFrame:
    """The limit of its window on every row.

    The limits are aggregated apart, not in a window frame, so that a crowded window is not sorted in
    one task. They are broadcast when ``max_windows`` bounds them, else joined by their size.
    """
    limits = window_limits(features, rel_err)
    if max_windows is not None:
        return features.join(F.broadcast(limits), "window_index")
    return lookup_join(features, limits, ["window_index"])


def label_viral(features: DataFrame, rel_err: float = 0.0, max_windows: int | None = None) -> DataFrame:
    """``is_viral_now``: count at the limit of its window and at the floor over all windows."""
    floor = count_floor(features, rel_err).scalar()
    count = F.col("req_count_current")
    return (
        add_window_limit(features, rel_err, max_windows)
        .withColumn("is_viral_now", ((count >= F.col("p95_limit")) & (count >= floor)).cast("int"))
        .drop("p95_limit")
    )


def build_gold(
    features: DataFrame,
    lookback: int = LOOKBACK_WINDOWS,
    ahead: int = AHEAD_WINDOWS,
    rel_err: float = 0.0,
) -> DataFrame:
    """Features of the closed windows in the lookback with the label of the window ``ahead``.

    The newest labelled windows have no future yet and are cut. Empty when there are not more than
    ``ahead`` closed windows. ``features`` is the stored silver table: its newest window is looked up
    first, so that the scans below read the lookback only.
    """
    newest = window_bounds(features).first()["max_window"]
    closed = features.where(F.col("window_index") < newest).select("window_index").distinct()
    if newest is None or closed.limit(ahead + 1).count() <= ahead:
        return features.sparkSession.createDataFrame([], GOLD)
    recent = in_lookback(features, lookback, newest)
    labeled = label_viral(recent, rel_err, max_windows=lookback)
    return (
        add_next_label(labeled, "is_viral_now", TARGET_COL, ahead)
        .where(F.col("window_index") < newest - ahead)
        .select(*GOLD.fieldNames())
    )

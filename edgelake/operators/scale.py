"""Joins and running sums that hold up when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from edgelake.session import short_shuffles, stored

BROADCAST_ROWS = 200_000
LINES_PER_BUCKET = 1 << 20
HORIZON_SLICES = 4
SALTS_PER_PART = 4


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a frame has at most ``max_rows`` rows, by a count in which every task sends one number."""
    return df.count() <= max_rows


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    small: bool | None = None,
) -> DataFrame:
    """Join with a side that is small as a rule: broadcast when its counted size allows, else salted.

    ``small`` is the outcome of an earlier count, of a frame that bounds this one.
    """
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), list(keys), how)
    return skew_join(left, right, keys, how)


def hot_keys(df: DataFrame, keys: Sequence[str], parts: int) -> list[tuple]:
    """Keys with more than one part in ``parts`` of the rows, each with its salts: fewer than ``parts``.

    One job finds the largest key, and only when that is hot another lists the hot ones.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    with short_shuffles(df.sparkSession):
        total, largest = counts.agg(F.sum("_rows"), F.max("_rows")).first()
        if not total or largest * parts <= total:
            return []
        share = F.col("_rows") * parts / total
        salts = F.ceil(share * SALTS_PER_PART).cast("int")
        return [tuple(r) for r in counts.where(share > 1).select(*keys, salts).collect()]


def skew_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", found: list[tuple] | None = None
) -> DataFrame:
    """Equi join of a long left side, whose keys may be hot, with few right rows per key.

    A key is hot when it has more than one part in P of the left rows, P being the number of shuffle
    partitions, so there are fewer than P such keys. A key with k parts is dealt over 4k salts, so that some
    falling together matters little, and only its right rows are repeated; without hot keys it is a plain join. ``how`` is one of inner,
    left, left_semi and left_anti. The keys of the left side are counted at once, unless ``found`` has the outcome of
    ``hot_keys``, so it is best a stored table, and these joins are not to be nested.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not repeat right rows safely for {how!r}")
    keys = list(keys)
    spark = left.sparkSession
    if found is None:
        found = hot_keys(left, keys, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not found:
        return left.join(right, keys, how)
    schema = StructType([*left.select(*keys).schema.fields, StructField("_salts", IntegerType())])
    hot = F.broadcast(spark.createDataFrame(found, schema))

    def add_salts(df: DataFrame) -> DataFrame:
        same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_h.{k}")) for k in keys]
        joined = df.alias("_l").join(hot.alias("_h"), same, "left")
        return joined.select("_l.*", F.coalesce("_salts", F.lit(1)).alias("_salts"))

    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    salted_left = add_salts(left).withColumn("_salt", F.pmod(row_hash, "_salts").cast("int")).drop("_salts")
    salted_right = (
        add_salts(right)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def prefix_sum(
    df: DataFrame,
    order: str,
    sums: dict[str, Column],
    by: Sequence[str] = (),
    width: int = LINES_PER_BUCKET,
) -> DataFrame:
    """Running sums along a whole-number column that is unique within ``by``.

    Rows are cut into buckets of ``width`` order values; one task sorts one bucket, and the totals of
    earlier buckets are added from a table with a row per bucket.
    """
    by = list(by)
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width).cast("bigint"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = rows.groupBy(*by, "_bucket").agg(
        *[F.sum(value.cast("bigint")).alias(f"_total_{name}") for name, value in sums.items()]
    )
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    running = {f"_inside_{n}": F.sum(value.cast("bigint")).over(inside) for n, value in sums.items()}
    return (
        rows.withColumns(running)
        .join(offsets, [*by, "_bucket"])
        .withColumns({n: F.col(f"_before_{n}") + F.col(f"_inside_{n}") for n in sums})
        .select(*df.columns, *sums)
    )


def seen_recently(
    rows: DataFrame,
    marks: DataFrame,
    key: str,
    at: str,
    marked_at: str,
    horizon: int,
    out: str,
    include_now: bool = False,
    slices: int = HORIZON_SLICES,
) -> DataFrame:
    """Flag rows whose key has a mark at most ``horizon`` before them, on whole-number clocks.

    ``0 < at - marked_at <= horizon``, or ``0 <= at - marked_at < horizon`` with ``include_now``.
    The clock is cut into slices of the horizon. Of the marks in the slice of a row the earliest decides, of
    those in the slices before it the latest: the join is on (key, slice) with these two numbers, and no key is
    sorted or windowed. A burst on one key falls into few slices; these are looked for in the two columns of the join
    alone, and only where there are some are the rows stored, and salted.
    """
    width = F.lit(max(1, horizon // slices))
    reach = -(-horizon // max(1, horizon // slices))
    per_slice = marks.groupBy(key, F.floor(F.col(marked_at) / width).cast("bigint").alias("_slice")).agg(
        F.min(marked_at).alias("_first"), F.max(marked_at).alias("_last")
    )
    none = F.lit(None).cast("bigint")
    same = per_slice.select(key, "_slice", "_first", none.alias("_prior"))
    later = F.explode(F.sequence(F.col("_slice") + 1, F.col("_slice") + reach))
    after = per_slice.select(key, later.alias("_slice"), none.alias("_first"), F.col("_last").alias("_prior"))
    near = same.unionByName(after).groupBy(key, "_slice").agg(
        F.min("_first").alias("_first"), F.max("_prior").alias("_prior")
    )
    now = F.col(at)
    if include_now:
        hit = (F.col("_first") <= now) | (now - F.col("_prior") < horizon)
    else:
        hit = (F.col("_first") < now) | (now - F.col("_prior") <= horizon)
    sliced = rows.withColumn("_slice", F.floor(now / width).cast("bigint"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(sliced.select(key, "_slice"), [key, "_slice"], parts)
    return (
        skew_join(stored(sliced, "sliced") if hot else sliced, near, [key, "_slice"], "left", hot)
        .withColumn(out, F.coalesce(hit, F.lit(False)).cast("int"))
        .drop("_slice", "_first", "_prior")
    )

"""Whole numbers without gaps for the rows of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelake.session import stored

ROW_BITS = 33


def numbered(df: DataFrame, name: str, out: str) -> DataFrame:
    """``df``, stored, with the place of every row in ``out``, from 0: partitions in order, and rows as they are in them.

    A partition numbers its own rows; the rows of earlier partitions come as one number per partition.
    """
    rows = stored(df.withColumn("_at", F.monotonically_increasing_id()), name).withColumn(
        "_part", F.shiftright("_at", ROW_BITS)
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + inside).alias(out))

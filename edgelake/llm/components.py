"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.session import drop_tables, short_shuffles, stored_at


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each node of an edge with the smallest node it can reach: node, component.

    Alternating large-star and small-star steps until the edges are stars. A step is an aggregate by node and a join
    with it; every step's edges are a stored table, and the driver sees whether there are any left to move.
    """
    spark = edges.sparkSession

    def large_star(df: DataFrame) -> DataFrame:
        both = df.select("a", "b").unionAll(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.where("a <> b")

    def small_star(df: DataFrame) -> DataFrame:
        down = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def moving(df: DataFrame) -> bool:
        """Whether a node has two centres, or a centre has one of its own."""
        children = df.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        centres = df.select(F.col("b").alias("a")).withColumn("centre", F.lit(1)).distinct()
        with short_shuffles(spark):
            return not children.join(centres, "a", "left").where("n > 1 OR centre = 1").isEmpty()

    current, path = stored_at(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
    more = not current.isEmpty()
    while more:
        following, next_path = stored_at(small_star(large_star(current)), "edges")
        drop_tables(spark, [path])
        path, current = next_path, following
        more = moving(current)
    tops = current.select(F.col("b").alias("node")).distinct()
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(
        tops.select("node", F.col("node").alias("component"))
    )

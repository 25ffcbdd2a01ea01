"""Content of the caches: who holds what, near whom.

A placement is a table ``(node_id, object_id)`` with every row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.functions.traffic import ratio
from edgelake.operators.features import get_requests
from edgelake.operators.node_maps import node_maps
from edgelake.operators.scale import lookup_join, prefix_sum, skew_join

KEYS = ["node_id", "object_id"]


def first_touch_placement(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, object_id, insert_line, slot)``: a node keeps each object it is first asked for.

    Nothing leaves, so a node takes its first ``capacity`` objects and no others. The slot numbers of
    a node are counted over buckets of lines, not in one sorted group.
    """
    touched = get_requests(requests).groupBy(*KEYS).agg(F.min("line_no").alias("insert_line"))
    slots = prefix_sum(touched, "insert_line", {"slot": F.lit(1)}, by=["node_id"])
    return (
        lookup_join(slots, nodes.select("node_id", "capacity"), ["node_id"])
        .where(F.col("slot") <= F.col("capacity"))
        .select(*KEYS, "insert_line", "slot")
    )


def insert_absent(placement: DataFrame, new: DataFrame) -> DataFrame:
    """Placement with the new rows it does not have yet."""
    fresh = new.select(*KEYS).distinct().join(placement, KEYS, "left_anti")
    return placement.select(*KEYS).unionByName(fresh)


def delete_rows(placement: DataFrame, gone: DataFrame) -> DataFrame:
    return placement.join(gone.select(*KEYS), KEYS, "left_anti")


def common_objects(placement: DataFrame, node: int, candidates: DataFrame) -> DataFrame:
    """Objects of one node that are in a list of candidates."""
    own = placement.where(F.col("node_id") == node).select("object_id")
    return own.join(candidates.select("object_id"), "object_id", "left_semi")


def holders(placement: DataFrame, neighbors: DataFrame, hop: int | None = None) -> DataFrame:
    """For every viewer and object the neighbours that hold it, of all hop levels or of one.

    ``(viewer, object_id, holders, min_hop)``, the holders ascending.
    """
    near = neighbors if hop is None else neighbors.where(F.col("hop") == hop)
    return (
        lookup_join(placement.select(*KEYS), near.select("viewer", "node_id", "hop"), ["node_id"])
        .groupBy("viewer", "object_id")
        .agg(F.array_sort(F.collect_list("node_id")).alias("holders"), F.min("hop").alias("min_hop"))
    )


def duplicate_candidates(placement: DataFrame, neighbors: DataFrame, hop: int | None = None) -> DataFrame:
    """``(node_id, object_id)`` of the rows that some neighbour (of one hop level) holds as well."""
    near = neighbors if hop is None else neighbors.where(F.col("hop") == hop)
    maps = node_maps(placement, near)
    found = maps.over(lambda m, alive: F.transform(F.filter("held", lambda c: m.candidate(c, alive)), m.node))
    return maps.rows.where(F.size("held") > 1).select(F.explode(found).alias("node_id"), "object_id")


def candidate_holders(candidates: DataFrame, placement: DataFrame, neighbors: DataFrame) -> DataFrame:
    """``(viewer, node_id)``: all neighbours that hold some candidate object of the viewer."""
    held = lookup_join(placement.select(*KEYS), neighbors.select("viewer", "node_id"), ["node_id"])
    wanted = candidates.select(F.col("node_id").alias("viewer"), "object_id")
    return held.join(wanted, ["viewer", "object_id"], "left_semi").select("viewer", "node_id").distinct()


def _reach(placement: DataFrame, neighbors: DataFrame, first: Column) -> DataFrame:
    """``(viewer, object_id, hop, since)``: earliest copy of an object at each hop level of a viewer."""
    rows = placement.select(*KEYS, first.alias("since"))
    own = rows.select(F.col("node_id").alias("viewer"), "object_id", F.lit(0).alias("hop"), "since")
    near = lookup_join(rows, neighbors.select("viewer", "node_id", "hop"), ["node_id"])
    return (
        near.select("viewer", "object_id", "hop", "since")
        .unionByName(own)
        .groupBy("viewer", "object_id", "hop")
        .agg(F.min("since").alias("since"))
    )


def nearest_replica(
    requests: DataFrame,
    placement: DataFrame,
    neighbors: DataFrame,
    cloud_hop: int,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Requests with ``distance``: 0 at a holder, else the least hop to one, else ``cloud_hop``.

    ``exclude`` names nodes whose copies do not count, the node of the request itself aside.
    """
    reach = _reach(placement, neighbors, F.lit(0))
    if exclude is not None:
        others = neighbors.join(exclude.select("node_id"), "node_id", "left_anti")
        reach = _reach(placement, others, F.lit(0))
    nearest = reach.groupBy("viewer", "object_id").agg(F.min("hop").alias("distance")).withColumnRenamed(
        "viewer", "node_id"
    )
    return skew_join(requests, nearest, KEYS, "left").fillna({"distance": cloud_hop})


def nearest_replica_asof(
    requests: DataFrame, inserts: DataFrame, neighbors: DataFrame, cloud_hop: int
) -> DataFrame:
    """``nearest_replica`` over the copies inserted before the line of the request.

    A viewer needs one line per hop level and object, the first at which a copy is that near. Those
    few levels come as one array per (viewer, object), so a request joins a single row.
    """
    levels = (
        _reach(inserts, neighbors, F.col("insert_line"))
        .groupBy(F.col("viewer").alias("node_id"), "object_id")
        .agg(F.collect_list(F.struct("hop", "since")).alias("_levels"))
    )
    there = F.filter("_levels", lambda level: level["since"] < F.col("line_no"))
    distance = F.array_min(F.transform(there, lambda level: level["hop"]))
    return (
        skew_join(requests, levels, KEYS, "left")
        .withColumn("distance", F.coalesce(distance, F.lit(cloud_hop)))
        .drop("_levels")
    )


def storage_utilization(placement: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node_id, used, capacity, utilization)`` of every node."""
    used = placement.groupBy("node_id").agg(F.count(F.lit(1)).alias("used"))
    return (
        nodes.select("node_id", "capacity")
        .join(used, "node_id", "left")
        .fillna({"used": 0})
        .withColumn("utilization", ratio(F.col("used"), F.col("capacity")))
        .select("node_id", "used", "capacity", "utilization")
    )


def over_limit(placement: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """Nodes whose utilization has reached the limit."""
    return storage_utilization(placement, nodes).where(F.col("utilization") >= limit)


def storage_series(requests: DataFrame, inserts: DataFrame, nodes: DataFrame, every_n: int) -> DataFrame:
    """``(sample, used, sample_millionths)``: use of all caches after every n-th GET.

    An insert happens at a GET, so numbers of GETs and of inserts run along the same lines.
    """
    marks = inserts.select(F.col("insert_line").alias("line_no"), F.lit(1).alias("added"))
    gets = get_requests(requests).select("line_no").join(marks, "line_no", "left")
    sums = {"get_seq": F.lit(1), "used": F.coalesce("added", F.lit(0))}
    capacity = nodes.agg(F.sum("capacity").cast("bigint").alias("capacity")).scalar()
    return (
        prefix_sum(gets, "line_no", sums)
        .where(F.col("get_seq") % every_n == 0)
        .withColumn("_capacity", capacity)
        .select(
            (F.col("get_seq") / every_n).cast("bigint").alias("sample"),
            "used",
            F.expr("used * 1000000 div _capacity").alias("sample_millionths"),
        )
    )


def average_utilization(series: DataFrame) -> DataFrame:
    mean = F.avg("sample_millionths") / 1_000_000
    return series.agg(F.coalesce(mean, F.lit(0.0)).alias("avg_storage_utilization"))

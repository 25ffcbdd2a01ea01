"""Redundant replicas: which may go, and sweeps that drop them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.operators.node_maps import View, bound, has, node_maps, without
from edgelake.operators.placement import KEYS, delete_rows, over_limit, storage_utilization
from edgelake.operators.scale import lookup_join
from edgelake.session import stored

# All decisions about an object depend on its own copies alone: a neighbour of a holder counts the
# copies it can see, and a node's turn is set by its own use before the sweep. So one row per object
# with the positions of its holders holds all a sweep needs, and objects are independent of each other.


def _ids(nodes: DataFrame) -> Column:
    """Ids of nodes as a constant; there are at most as many as nodes."""
    return F.lit(np.array([r[0] for r in nodes.select("node_id").distinct().collect()], np.int32))


def delete_permission(placement: DataFrame, neighbors: DataFrame) -> DataFrame:
    """``(node_id, object_id, permitted)`` of every copy."""
    maps = node_maps(placement, neighbors)
    verdicts = maps.over(lambda m, alive: F.transform("held", lambda c: F.struct(
        m.node(c).alias("node_id"), m.permitted(c, alive).cast("int").alias("permitted")
    )))
    return maps.rows.select("object_id", F.explode(verdicts).alias("c")).select("c.node_id", "object_id", "c.permitted")


def sweep_plan(
    placement: DataFrame,
    neighbors: DataFrame,
    nodes: DataFrame,
    limit: float,
    viral: DataFrame | None = None,
) -> DataFrame:
    """What every over-full node does with its copies, node after node in ascending order.

    ``(node_id, object_id, candidate, permitted, protected, dropped)`` for the copies on over-full
    nodes. A drop is seen by the nodes that come after. ``viral`` lists objects that must stay.
    """
    turns = _ids(over_limit(placement, nodes, limit))
    maps = node_maps(placement, neighbors)
    if viral is None:
        rows = maps.rows.withColumn("viral", F.lit(False))
    else:
        flags = viral.select("object_id").distinct().withColumn("viral", F.lit(True))
        rows = maps.rows.join(flags, "object_id", "left").fillna({"viral": False})

    log_type = "array<struct<node_id:int,candidate:boolean,permitted:boolean,dropped:boolean>>"

    def decide(m: View, state: Column, c: Column) -> Column:
        candidate = m.candidate(c, state["alive"])
        permitted = m.permitted(c, state["alive"])
        verdict = F.struct(candidate.alias("candidate"), permitted.alias("permitted"))
        return bound(verdict, lambda v: apply(m, state, c, v))

    def apply(m: View, state: Column, c: Column, verdict: Column) -> Column:
        dropped = verdict["candidate"] & verdict["permitted"] & ~F.col("viral")
        entry = F.struct(
            m.node(c).alias("node_id"),
            verdict["candidate"].alias("candidate"),
            verdict["permitted"].alias("permitted"),
            dropped.alias("dropped"),
        )
        return F.struct(
            F.when(dropped, without(state["alive"], c)).otherwise(state["alive"]).alias("alive"),
            F.concat(state["log"], F.array(entry)).alias("log"),
        )

    def swept(m: View, alive: Column) -> Column:
        own = F.filter("held", lambda c: F.array_contains(turns, m.node(c)))
        start = F.struct(alive.alias("alive"), F.array().cast(log_type).alias("log"))
        return F.aggregate(own, start, lambda state, c: decide(m, state, c), lambda state: state["log"])

    return (
        rows.select("object_id", "viral", F.explode(maps.over(swept)).alias("e"))
        .select(
            "e.node_id",
            "object_id",
            F.col("e.candidate").cast("int").alias("candidate"),
            (F.col("e.candidate") & F.col("e.permitted")).cast("int").alias("permitted"),
            (F.col("e.candidate") & F.col("e.permitted") & F.col("viral")).cast("int").alias("protected"),
            F.col("e.dropped").cast("int").alias("dropped"),
        )
    )


def dedup_basic(
    placement: DataFrame, neighbors: DataFrame, nodes: DataFrame, limit: float, viral: DataFrame | None = None
) -> DataFrame:
    """The rows a sweep drops."""
    return sweep_plan(placement, neighbors, nodes, limit, viral).where("dropped = 1").select(*KEYS)


def mean_hops(neighbors: DataFrame, hops: DataFrame, initiator: int) -> DataFrame:
    """``(node_id, total_hop)``: summed hops from the initiator and its neighbours to each neighbour.

    The group is the same for all, so sums rank the nodes as means do.
    """
    near = neighbors.where(F.col("viewer") == initiator).select("node_id")
    group = near.select(F.col("node_id").alias("src")).unionByName(
        near.sparkSession.range(1).select(F.lit(initiator).alias("src"))
    )
    return (
        hops.join(group, "src")
        .join(near.select(F.col("node_id").alias("dst")), "dst")
        .groupBy(F.col("dst").alias("node_id"))
        .agg(F.sum("hop").alias("total_hop"))
    )


def latency_permissions(placement: DataFrame, neighbors: DataFrame, hops: DataFrame, initiator: int) -> DataFrame:
    """``(object_id, node_id, permitted, total_hop)``: copies near the initiator of objects it holds."""
    reach = stored(mean_hops(neighbors, hops, initiator), "reach")
    maps, near = node_maps(placement, neighbors), _ids(reach)

    def verdicts(m: View, alive: Column) -> Column:
        asked = F.filter("held", lambda c: F.array_contains(near, m.node(c)))
        own = F.exists("held", lambda c: m.node(c) == initiator)
        return F.when(own & (F.size("held") > 1), F.transform(asked, lambda c: F.struct(
            m.node(c).alias("node_id"), m.permitted(c, alive).alias("permitted")
        )))

    found = maps.rows.select("object_id", F.explode(maps.over(verdicts)).alias("c"))
    return lookup_join(found.select("object_id", "c.*"), reach, ["node_id"]).select(
        "object_id", "node_id", "permitted", "total_hop"
    )


def choose_victims(permissions: DataFrame) -> DataFrame:
    """``(object_id, node_id)``: of the permitted copies the farthest one, the highest id among equals."""
    return (
        permissions.where("permitted")
        .groupBy("object_id")
        .agg(F.max(F.struct("total_hop", "node_id")).alias("v"))
        .select("object_id", F.col("v.node_id").alias("node_id"))
    )


def dedup_latency(
    placement: DataFrame, neighbors: DataFrame, hops: DataFrame, initiator: int, viral: DataFrame | None = None
) -> DataFrame:
    """The rows one initiator has dropped: per object it shares, the farthest copy that may go."""
    victims = choose_victims(latency_permissions(placement, neighbors, hops, initiator))
    if viral is not None:
        victims = victims.join(viral.select("object_id").distinct(), "object_id", "left_anti")
    return victims.select(*KEYS)


def group_hops(neighbors: DataFrame, hops: DataFrame) -> DataFrame:
    """``(viewer, node_id, total_hop)``: ``mean_hops`` of every viewer as the initiator."""
    near = neighbors.select("viewer", "node_id").distinct()
    own = near.select("viewer", F.col("viewer").alias("src")).distinct()
    group = near.select("viewer", F.col("node_id").alias("src")).unionAll(own)
    ways = near.join(group, "viewer").select("viewer", "src", F.col("node_id").alias("dst"))
    return ways.join(hops, ["src", "dst"]).groupBy("viewer", F.col("dst").alias("node_id")).agg(
        F.sum("hop").alias("total_hop")
    )


@dataclass
class LatencySweep:
    """A sweep of initiators in turn: ``drops`` has (turn, node_id, object_id), ``gates`` (turn, node_id, used, open), ``used`` being
    the copies on a node when its turn comes; ``passes`` is how often all objects were gone through."""

    placement: DataFrame
    drops: DataFrame
    gates: DataFrame
    passes: int


def latency_sweep(
    placement: DataFrame,
    neighbors: DataFrame,
    hops: DataFrame,
    nodes: DataFrame,
    limit: float,
    initiators: Iterable[int],
    viral: DataFrame | None = None,
) -> LatencySweep:
    """Initiators in turn; a node below the limit when its turn comes is passed.

    What couples objects is only which turns are open. For given gates every object goes through all turns by
    itself; the drops give each node's use at its turn, and that the gates of the next pass. A gate hangs on earlier turns
    only, so a pass settles at least one more, and gates that do not change are those of one turn after the other. The
    driver holds a number per turn.
    """
    spark = placement.sparkSession
    held = stored(placement.select(*KEYS).distinct(), "placement")
    turns = [(turn, int(node)) for turn, node in enumerate(initiators)]
    schema = "turn int, node_id int"
    at = stored(spark.createDataFrame(turns, schema), "turns")
    use = at.join(storage_utilization(held, nodes), "node_id", "left").select("turn", "used", "capacity").collect()
    first = {r["turn"]: (r["used"] or 0, r["capacity"] or 0) for r in use}
    near = neighbors.select("viewer", "node_id").distinct().join(group_hops(neighbors, hops), ["viewer", "node_id"], "left")
    maps = node_maps(held, near.fillna({"total_hop": 0}), "total_hop")
    own = lookup_join(held, at, ["node_id"]).groupBy("object_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "node_id"))).alias("turns")
    )
    rows = maps.rows.where(F.size("held") > 1).join(own, "object_id")
    if viral is not None:
        rows = rows.join(viral.select("object_id").distinct(), "object_id", "left_anti")
    rows = stored(rows, "objects")

    log_type = "array<struct<turn:int,node_id:int>>"

    def act(m: View, state: Column, turn: Column) -> Column:
        def victim_of(pos: Column) -> Column:
            free = F.filter(m.neighbours(pos), lambda n: has(state["alive"], n) & m.permitted(n, state["alive"]))
            return F.when(has(state["alive"], pos), F.get(free, F.lit(0)))

        return bound(bound(m.position(turn["node_id"]), victim_of), lambda v: F.when(v.isNull(), state).otherwise(F.struct(
            without(state["alive"], v).alias("alive"),
            F.concat(state["log"], F.array(F.struct(turn["turn"].alias("turn"), m.node(v).alias("node_id")))).alias("log"),
        )))

    def one_pass(open_: list[bool]) -> DataFrame:
        gates = F.lit(np.array(open_, np.int32))
        acting = F.filter("turns", lambda t: F.get(gates, t["turn"]) == 1)

        def swept(m: View, alive: Column) -> Column:
            start = F.struct(alive.alias("alive"), F.array().cast(log_type).alias("log"))
            return F.aggregate(acting, start, lambda state, turn: act(m, state, turn), lambda state: state["log"])

        found = rows.select("object_id", F.explode(maps.over(swept)).alias("d"))
        return stored(found.select("d.turn", "d.node_id", "object_id"), "drops")

    def used_at_turns(drops: DataFrame) -> list[int]:
        counts = drops.groupBy(F.col("turn").alias("_turn"), "node_id").agg(F.count(F.lit(1)).alias("n"))
        gone = lookup_join(counts, at, ["node_id"]).where("_turn < turn").groupBy("turn").agg(F.sum("n").alias("n"))
        lost = {r["turn"]: r["n"] for r in gone.collect()}
        return [first[turn][0] - lost.get(turn, 0) for turn, _ in turns]

    def opened(used: list[int]) -> list[bool]:
        return [bool(first[turn][1]) and used[turn] / first[turn][1] >= limit for turn, _ in turns]

    used = [first[turn][0] for turn, _ in turns]
    open_, passes, drops = opened(used), 0, spark.createDataFrame([], "turn int, node_id int, object_id bigint")
    while turns:
        drops, passes = one_pass(open_), passes + 1
        used = used_at_turns(drops)
        if (again := opened(used)) == open_:
            break
        open_ = again
    gates = [(turn, node, used[turn], open_[turn]) for turn, node in turns]
    return LatencySweep(
        delete_rows(held, drops), drops, spark.createDataFrame(gates, "turn int, node_id int, used long, open boolean"), passes
    )


def dedup_latency_sweep(
    placement: DataFrame,
    neighbors: DataFrame,
    hops: DataFrame,
    nodes: DataFrame,
    limit: float,
    initiators: Iterable[int],
    viral: DataFrame | None = None,
) -> DataFrame:
    """Placement after several initiators in turn."""
    return latency_sweep(placement, neighbors, hops, nodes, limit, initiators, viral).placement


def eviction_log(before: DataFrame, after: DataFrame, line: int, viral: DataFrame | None = None) -> DataFrame:
    """``(node_id, object_id, line_no, viral)`` of the rows that a sweep at a line has taken away."""
    gone = before.select(*KEYS).join(after, KEYS, "left_anti").withColumn("line_no", F.lit(line).cast("bigint"))
    if viral is None:
        return gone.withColumn("viral", F.lit(0))
    flags = viral.select("object_id").distinct().withColumn("viral", F.lit(1))
    return gone.join(flags, "object_id", "left").fillna({"viral": 0}).select(*KEYS, "line_no", "viral")


def eviction_counts(evictions: DataFrame) -> DataFrame:
    return evictions.agg(
        F.count(F.lit(1)).alias("evicted_files"),
        F.coalesce(F.sum("viral"), F.lit(0)).cast("bigint").alias("evicted_viral_files"),
    )


def message_overhead(plan: DataFrame, neighbors: DataFrame, over_full: DataFrame) -> DataFrame:
    """``(node_id, packs, trans_hops)`` of a sweep: candidates asked about, hops to all neighbours."""
    packs = plan.groupBy("node_id").agg(F.sum("candidate").alias("packs"))
    hops = neighbors.groupBy(F.col("viewer").alias("node_id")).agg(F.sum("hop").alias("trans_hops"))
    return (
        over_full.select("node_id")
        .join(packs, "node_id", "left")
        .join(hops, "node_id", "left")
        .fillna({"packs": 0, "trans_hops": 0})
    )


def latency_overhead(permissions: DataFrame, neighbors: DataFrame, initiator: int) -> DataFrame:
    """``(packs, trans_hops)`` of one initiator: its own questions and those of every holder it asks."""
    own = permissions.agg(F.count_distinct("object_id").alias("own")).scalar()
    asked = permissions.groupBy("node_id").agg(F.count(F.lit(1)).alias("same"))
    first = neighbors.where(F.col("viewer") == initiator).select("node_id", "hop")
    second = neighbors.groupBy(F.col("viewer").alias("node_id")).agg(F.sum("hop").alias("onward"))
    per_holder = asked.join(first, "node_id").join(second, "node_id", "left")
    return per_holder.agg(
        (F.coalesce(F.sum("same"), F.lit(0)) + own).cast("bigint").alias("packs"),
        F.coalesce(F.sum(F.col("hop") + F.coalesce("onward", F.lit(0))), F.lit(0)).cast("bigint").alias("trans_hops"),
    )

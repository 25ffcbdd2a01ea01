"""Hop distances, neighbourhoods and shortest-path trees of the node graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgelake.operators.node_maps import bit_of, word_of
from edgelake.operators.scale import is_small, lookup_join
from edgelake.session import stored

LAZY_ROUNDS = 4


def undirected(edges: DataFrame) -> DataFrame:
    """Edges in both directions, once each, without self loops."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(back).where(F.col("src") != F.col("dst")).distinct()


def node_positions(nodes: DataFrame) -> DataFrame:
    """``(node_id, pos)``: nodes numbered by ascending id; stored."""
    place = F.row_number().over(Window.orderBy("node_id")) - 1
    return stored(nodes.select("node_id").distinct().select("node_id", place.cast("int").alias("pos")), "positions")


def reached_sources(edges: DataFrame, positions: DataFrame, max_hop: int | None = None) -> DataFrame:
    """``(node_id, block, hop, bits)``: which sources of a block of 64 are at ``hop`` from a node, as a bitmap.

    All sources of a block are searched at once: a round joins the bitmaps that are new at a node with its edges and takes one
    ``bit_or`` per node and block. Few rounds are one plan; more, or an open end, are stored round by round, so that plans stay
    short and a lost executor costs one round.
    """
    small = is_small(edges)
    step = stored(edges.select("src", "dst"), "edges").select(F.col("src").alias("node_id"), F.col("dst").alias("_next"))
    own = positions.select("node_id", word_of(F.col("pos")).alias("block"), bit_of(F.col("pos")).alias("bits"))
    none = F.lit(0).cast("bigint")

    def spread(df: DataFrame) -> DataFrame:
        return lookup_join(df, step, ["node_id"], small=small).select(F.col("_next").alias("node_id"), "block", "bits")

    if max_hop is not None and max_hop <= LAZY_ROUNDS:
        ends, found = own, own.withColumn("hop", F.lit(0))
        for hop in range(1, max_hop + 1):
            ends = spread(ends).groupBy("node_id", "block").agg(F.bit_or("bits").alias("bits"))
            found = found.unionByName(ends.withColumn("hop", F.lit(hop)))
        at = [F.coalesce(F.bit_or(F.when(F.col("hop") == h, F.col("bits"))), none).alias(f"_{h}") for h in range(max_hop + 1)]
        levels, before = [], none
        for h in range(max_hop + 1):
            levels.append(F.struct(F.lit(h).alias("hop"), F.col(f"_{h}").bitwiseAND(F.bitwise_not(before)).alias("bits")))
            before = before.bitwiseOR(F.col(f"_{h}"))
        return found.groupBy("node_id", "block").agg(*at).select(
            "node_id", "block", F.explode(F.array(*levels)).alias("level")
        ).select("node_id", "block", "level.*").where("bits <> 0")

    state = stored(own.select("node_id", "block", F.col("bits").alias("new"), F.col("bits").alias("seen")), "reached")
    found, hop = state.select("node_id", "block", F.lit(0).alias("hop"), F.col("new").alias("bits")), 0
    while max_hop is None or hop < max_hop:
        hop += 1
        come = spread(state.where("new <> 0").select("node_id", "block", F.col("new").alias("bits")))
        both = come.select("node_id", "block", "bits", none.alias("seen")).unionAll(
            state.select("node_id", "block", none, "seen")
        )
        merged = both.groupBy("node_id", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        new = F.col("bits").bitwiseAND(F.bitwise_not("seen"))
        state = stored(
            merged.select("node_id", "block", new.alias("new"), F.col("seen").bitwiseOR(F.col("bits")).alias("seen")), "reached"
        )
        fresh = state.where("new <> 0")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh.select("node_id", "block", F.lit(hop).alias("hop"), F.col("new").alias("bits")))
    return found


def hop_distances(edges: DataFrame, nodes: DataFrame, max_hop: int | None = None) -> DataFrame:
    """``(src, dst, hop)`` of all pairs of nodes, a node itself at 0, up to ``max_hop``.

    ``edges`` has both directions. The bitmaps of the search are taken apart to pairs at the very end only.
    """
    positions = node_positions(nodes)
    found = reached_sources(edges, positions, max_hop)
    is_set = lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(1) == 1
    places = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), is_set), lambda i: F.col("block") * 64 + i)
    pairs = found.select(F.col("node_id").alias("dst"), "hop", F.explode(places).alias("pos"))
    sources = positions.select(F.col("node_id").alias("src"), "pos")
    return lookup_join(pairs, sources, ["pos"]).select("src", "dst", "hop")


def neighborhood(hops: DataFrame, nodes: DataFrame, max_hop: int) -> DataFrame:
    """``(viewer, node_id, hop, capacity)``: the other nodes within ``max_hop`` of each viewer."""
    near = hops.where((F.col("hop") > 0) & (F.col("hop") <= max_hop)).select(
        F.col("src").alias("viewer"), F.col("dst").alias("node_id"), "hop"
    )
    return lookup_join(near, nodes.select("node_id", "capacity"), ["node_id"]).select(
        "viewer", "node_id", "hop", "capacity"
    )


def shortest_path_trees(edges: DataFrame, nodes: DataFrame, max_hop: int) -> DataFrame:
    """``(source, node_id, parent, hop)`` of the breadth-first tree of every source.

    Breadth-first search takes the parent that was queued first, and siblings by id. In that order a
    level is sorted by its paths of ids, so the path to a node is the smallest of its shortest paths.
    """
    step = stored(edges.select(F.col("src").alias("_via"), F.col("dst").alias("_next")), "edges")
    level = stored(
        nodes.select(F.col("node_id").alias("source"), F.col("node_id"), F.array("node_id").alias("path")), "paths"
    )
    met, tree = level.select("source", "node_id"), level
    for _ in range(max_hop):
        grown = (
            level.join(step, level["node_id"] == step["_via"])
            .select("source", F.col("_next").alias("node_id"), F.concat("path", F.array("_next")).alias("path"))
            .join(met, ["source", "node_id"], "left_anti")
            .groupBy("source", "node_id")
            .agg(F.min("path").alias("path"))
        )
        level = stored(grown, "paths")
        if level.isEmpty():
            break
        met = met.union(level.select("source", "node_id"))
        tree = tree.union(level)
    hop = F.size("path") - 1
    return tree.where(hop > 0).select(
        "source", "node_id", F.element_at("path", -2).alias("parent"), hop.alias("hop")
    )

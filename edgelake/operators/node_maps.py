"""Holders and neighbourhoods as bitmaps over node positions.

Nodes are numbered by ascending id. An object carries the positions of its holders only; whom a node sees is asked of a
bitmap per node, which all objects share: how many copies a node sees is the number of ones in the AND of two bitmaps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelake.operators.scale import lookup_join
from edgelake.session import stored

MAP_BYTES = 8 << 20
WORD_BITS = 64
MAPS = "ids array<int>, near array<array<int>>, views array<array<bigint>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_of(pos: Column) -> Column:
    return F.call_function("shiftright", pos.cast("int"), F.lit(6))


def bit_of(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), pos.cast("int").bitwiseAND(F.lit(63)))


def has(bits: Column, pos: Column) -> Column:
    return F.get(bits, word_of(pos)).bitwiseAND(bit_of(pos)) != 0


def without(bits: Column, pos: Column) -> Column:
    return F.transform(
        bits, lambda w, i: F.when(i == word_of(pos), w.bitwiseAND(F.bitwise_not(bit_of(pos)))).otherwise(w)
    )


def bits_of(positions: Column, n: Column) -> Column:
    """Bitmap of ``n`` positions in which the given ones are set."""
    zero = F.lit(0).cast("bigint")
    words = F.sequence(F.lit(0), F.greatest(word_of(n - 1), F.lit(0)))
    return F.transform(words, lambda i: F.aggregate(
        positions, zero, lambda s, p: F.when(word_of(p) == i, s.bitwiseOR(bit_of(p))).otherwise(s)
    ))


def sees_others(alive: Column, view: Column) -> Column:
    """Whether more than one copy is in the view."""
    common = F.zip_with(alive, view, lambda a, b: F.bit_count(a.bitwiseAND(b)))
    return F.aggregate(common, F.lit(0), lambda s, n: s + n) > 1


class View:
    """Maps inside an expression: by position ``ids`` gives node ids, ``near`` the positions of a node's neighbours, and
    ``views`` the bitmap of the nodes in whose neighbourhood a node is."""

    def __init__(self, maps: Column):
        self.ids, self.near, self.views = maps["ids"], maps["near"], maps["views"]

    def alive(self, held: Column) -> Column:
        return bits_of(held, F.size(self.ids))

    def node(self, pos: Column) -> Column:
        return F.get(self.ids, pos)

    def position(self, node: Column) -> Column:
        return F.array_position(self.ids, node).cast("int") - 1

    def neighbours(self, pos: Column) -> Column:
        return F.get(self.near, pos)

    def candidate(self, pos: Column, alive: Column) -> Column:
        """Some neighbour has a copy."""
        return F.exists(self.neighbours(pos), lambda n: has(alive, n))

    def permitted(self, pos: Column, alive: Column) -> Column:
        """Every neighbour of the holder sees more than one copy; true when there are no neighbours."""
        return F.forall(self.neighbours(pos), lambda n: sees_others(alive, F.get(self.views, n)))


@dataclass
class NodeMaps:
    """``rows`` has an object and the positions of its holders, ascending (object_id, held); ``maps`` is one value for all
    rows or a column of them."""

    rows: DataFrame
    maps: Column

    def over(self, body: Callable[[View, Column], Column]) -> Column:
        """``body`` of the maps and the bitmap of an object's holders."""
        return bound(self.maps, lambda m: bound(View(m).alive(F.col("held")), lambda alive: body(View(m), alive)))


def node_maps(placement: DataFrame, neighbors: DataFrame, farthest: str | None = None) -> NodeMaps:
    """Maps of the copies ``(node_id, object_id)`` and the neighbourhoods ``(viewer, node_id)``.

    ``farthest`` names a column of ``neighbors``: neighbours are then listed by it, the highest first, the higher id
    among equals. Up to MAP_BYTES of maps are one constant of the plan, shared by all objects (they grow with the square of the
    nodes); beyond, every object gets maps of its own holders and their neighbours, from a join.
    """
    held = placement.select("node_id", "object_id")
    key = F.lit(0) if farthest is None else F.col(farthest)
    pairs = stored(neighbors.select("viewer", "node_id", (-key).alias("rank")).distinct(), "pairs")
    known = held.select("node_id").unionAll(pairs.select("viewer")).unionAll(pairs.select("node_id")).distinct()
    positions = stored(
        known.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("int").alias("pos")), "positions"
    )
    n = positions.count()
    if n * -(-n // WORD_BITS) * 8 + 4 * pairs.count() <= MAP_BYTES:
        return _shared(held, pairs, positions, n)
    return _own(held, pairs)


def _shared(held: DataFrame, pairs: DataFrame, positions: DataFrame, n: int) -> NodeMaps:
    viewers = positions.select(F.col("node_id").alias("viewer"), F.col("pos").alias("v"))
    placed = pairs.join(F.broadcast(viewers), "viewer").join(F.broadcast(positions), "node_id").select("v", "pos", "rank")
    lists = placed.groupBy(F.col("v").alias("pos")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", (-F.col("pos")).alias("p")))), lambda x: -x["p"]).alias("near")
    )
    words = placed.groupBy("pos", word_of(F.col("v")).alias("w")).agg(F.bit_or(bit_of(F.col("v"))).alias("bits"))
    entries = words.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(max(0, n - 1) // WORD_BITS))
    packed = entries.select("pos", F.transform(every, lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("bigint"))).alias("view"))
    nothing = F.transform(every, lambda w: F.lit(0).cast("bigint"))
    whole = positions.join(lists, "pos", "left").join(packed, "pos", "left").select(
        F.struct(
            "pos",
            F.col("node_id").alias("id"),
            F.coalesce("near", F.array().cast("array<int>")).alias("near"),
            F.coalesce("view", nothing).alias("view"),
        ).alias("node")
    )
    nodes = F.array_sort(F.collect_list("node"))
    text = whole.agg(nodes.alias("n")).select(
        F.to_json(F.struct(F.col("n.id").alias("ids"), F.col("n.near").alias("near"), F.col("n.view").alias("views")))
    ).first()[0]
    rows = lookup_join(held, positions, ["node_id"], small=True).groupBy("object_id").agg(
        F.array_sort(F.collect_list("pos")).alias("held")
    )
    return NodeMaps(rows, F.from_json(F.lit(text), MAPS))


def _own(held: DataFrame, pairs: DataFrame) -> NodeMaps:
    around = held.join(pairs.select(F.col("viewer").alias("node_id"), F.col("node_id").alias("n"), "rank"), "node_id", "left")
    grouped = around.groupBy("object_id").agg(
        F.collect_set(F.struct("rank", (-F.col("n")).alias("n"), F.col("node_id").alias("c"))).alias("pairs"),
        F.array_sort(F.collect_set("node_id")).alias("c"),
        F.collect_set("n").alias("n"),
    )
    ids = grouped.select("object_id", "pairs", "c", F.array_sort(F.array_union("c", "n")).alias("ids"))

    def place(node: Column) -> Column:
        return F.array_position("ids", node).cast("int") - 1

    def near(node: Column) -> Column:
        own = F.filter("pairs", lambda p: (p["c"] == node) & p["n"].isNotNull())
        return F.transform(F.array_sort(own), lambda p: place(-p["n"]))

    def view(node: Column) -> Column:
        seen_by = F.transform(F.filter("pairs", lambda p: p["n"] == -node), lambda p: place(p["c"]))
        return bits_of(seen_by, F.size("ids"))

    rows = ids.select(
        "object_id",
        F.transform("c", place).alias("held"),
        "ids",
        F.transform("ids", near).alias("near"),
        F.transform("ids", view).alias("views"),
    )
    return NodeMaps(stored(rows, "maps"), F.struct("ids", "near", "views"))

"""Approximate membership: counting Bloom filters and fingerprint filters as tables.

A filter is a set of rows, so building, merging, deleting and probing are groupings and joins, and
many filters (one per group) are built at once. Probes never miss a member.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelake.functions.sketch import bloom_positions, fingerprint, fingerprint_bits
from edgelake.operators.node_maps import bit_of, word_of
from edgelake.operators.scale import is_small, lookup_join, skew_join
from edgelake.session import stored

FILTER_BYTES = 64 << 20

# Counting Bloom filter: (group..., pos, cnt)


def cbf_build(df: DataFrame, group: Sequence[str], col: str, n_bits: int, n_hashes: int) -> DataFrame:
    """Counters of the positions of all rows, one filter per group; equal rows are counted first."""
    group = list(group)
    return (
        df.groupBy(*group, col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_n", F.explode(bloom_positions(F.col(col), n_bits, n_hashes)).alias("pos"))
        .groupBy(*group, "pos")
        .agg(F.sum("_n").alias("cnt"))
    )


def cbf_merge(first: DataFrame, second: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Sum of two filters of one size."""
    return first.unionByName(second).groupBy(*group, "pos").agg(F.sum("cnt").alias("cnt"))


def cbf_words(cbf: DataFrame, group: Sequence[str], n_bits: int) -> DataFrame:
    """Filters as bitmaps, one row per group: ``words`` has 64 positions per number."""
    bit = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    used = cbf.where("cnt > 0").select(*group, F.expr("pos div 64").alias("word"), bit.alias("bits"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(-(-n_bits // 64) - 1).cast("bigint")))
    groups = cbf.select(*group).distinct() if group else cbf.sparkSession.range(1).select()
    empty = groups.select(*group, every.alias("word"), F.lit(0).cast("bigint").alias("bits"))
    whole = used.unionByName(empty).groupBy(*group, "word").agg(F.bit_or("bits").alias("bits"))
    return whole.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("words"))


def cbf_semi_join(
    df: DataFrame, cbf: DataFrame, group: Sequence[str], col: str, n_bits: int, n_hashes: int
) -> DataFrame:
    """Rows whose positions are all set in the filter of their group.

    The filters are packed to bitmaps; as long as these have at most FILTER_BYTES together they are broadcast, and
    no probe is shuffled. Beyond that every distinct value is probed once by position, and the verdict goes back
    to its rows by a salted join.
    """
    group = list(group)
    filters = cbf.select(*group).distinct().count() if group else 1
    if filters * n_bits <= 8 * FILTER_BYTES:
        def is_set(pos: Column) -> Column:
            word = F.get("words", (pos / 64).cast("int"))
            return F.call_function("shiftright", word, (pos % 64).cast("int")).bitwiseAND(1) == 1

        words = F.broadcast(cbf_words(cbf, group, n_bits))
        probes = df.join(words, group) if group else df.withColumn("words", words.scalar())
        return probes.where(F.forall(bloom_positions(F.col(col), n_bits, n_hashes), is_set)).select(*df.columns)
    probes = df.select(*group, col).distinct()
    found = _cbf_found(probes, cbf, group, col, n_bits, n_hashes)
    return skew_join(df, found, [*group, col], "left_semi")


def _cbf_found(
    probes: DataFrame, cbf: DataFrame, group: Sequence[str], col: str, n_bits: int, n_hashes: int
) -> DataFrame:
    """Those of the distinct probes, with all their columns, whose positions are all set."""
    places = F.array_distinct(bloom_positions(F.col(col), n_bits, n_hashes))
    laid = probes.withColumn("_places", places).select(
        *probes.columns, F.size("_places").alias("_wanted"), F.explode("_places").alias("pos")
    )
    return (
        laid.join(cbf.where("cnt > 0").select(*group, "pos"), [*group, "pos"], "left_semi")
        .groupBy(*probes.columns, "_wanted")
        .agg(F.count(F.lit(1)).alias("_met"))
        .where("_met = _wanted")
        .select(*probes.columns)
    )


def cbf_delete(
    cbf: DataFrame, keys: DataFrame, group: Sequence[str], col: str, n_bits: int, n_hashes: int
) -> DataFrame:
    """Filter with one insert less per key, as often as the key seems to be in it; others change nothing."""
    group = list(group)
    asked = keys.groupBy(*group, col).agg(F.count(F.lit(1)).alias("_asked"))
    laid = (
        asked.select(*group, col, "_asked", F.explode(bloom_positions(F.col(col), n_bits, n_hashes)).alias("pos"))
        .groupBy(*group, col, "_asked", "pos")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    held = F.floor(F.coalesce("cnt", F.lit(0)) / F.col("_times"))
    taken = (
        laid.join(cbf, [*group, "pos"], "left")
        .groupBy(*group, col, "_asked")
        .agg(F.min(held).alias("_held"))
        .select(*group, col, F.least("_asked", "_held").alias("_n"))
        .where("_n > 0")
    )
    minus = (
        taken.select(*group, "_n", F.explode(bloom_positions(F.col(col), n_bits, n_hashes)).alias("pos"))
        .groupBy(*group, "pos")
        .agg((-F.sum("_n")).alias("cnt"))
    )
    return cbf_merge(cbf, minus, group).where("cnt > 0")


# Fingerprint filter: (group..., fp, cnt), exact on the low bits of the hash


def _bits(bits: int | str) -> Column:
    return F.lit(bits) if isinstance(bits, int) else F.col(bits)


def qf_build(df: DataFrame, group: Sequence[str], col: str, bits: int | str) -> DataFrame:
    """Fingerprint counts, one filter per group; ``bits`` is a number or a column of the rows."""
    fp = fingerprint(F.col(col), _bits(bits)).alias("fp")
    return df.groupBy(*group, fp).agg(F.count(F.lit(1)).alias("cnt"))


def qf_semi_join(df: DataFrame, qf: DataFrame, group: Sequence[str], col: str, bits: int | str) -> DataFrame:
    """Rows whose fingerprint is in the filter of their group."""
    probes = df.withColumn("fp", fingerprint(F.col(col), _bits(bits)))
    return skew_join(probes, _held(qf, group), [*group, "fp"], "left_semi").drop("fp")


def _held(qf: DataFrame, group: Sequence[str]) -> DataFrame:
    return qf.where("cnt > 0").select(*group, "fp")


def qf_delete(qf: DataFrame, keys: DataFrame, group: Sequence[str], col: str, bits: int | str) -> DataFrame:
    """Filter with one copy of a fingerprint less per key; fingerprints it lacks change nothing."""
    minus = qf_build(keys, group, col, bits).withColumnRenamed("cnt", "_minus")
    return (
        qf.join(minus, [*group, "fp"], "left")
        .withColumn("cnt", F.col("cnt") - F.coalesce("_minus", F.lit(0)))
        .where("cnt > 0")
        .drop("_minus")
    )


# Index tree of a viewer: a leaf filter per neighbour, one per hop level, one for all

LEVELS = {"root": ["viewer"], "level": ["viewer", "hop"], "leaf": ["viewer", "hop", "node_id"]}


def tree_sizes(neighbors: DataFrame, false_positive_rate: float) -> DataFrame:
    """``(kind, viewer, hop, node_id, volume, bits)``: fingerprint bits of every filter by the volume below."""
    rows = None
    for kind, keys in LEVELS.items():
        part = neighbors.groupBy(*keys).agg(F.sum("capacity").cast("bigint").alias("volume")).select(
            F.lit(kind).alias("kind"),
            *[F.col(c) if c in keys else F.lit(None).cast("int").alias(c) for c in LEVELS["leaf"]],
            "volume",
            fingerprint_bits(F.col("volume"), false_positive_rate).alias("bits"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def cbf_tree(placement: DataFrame, neighbors: DataFrame, n_bits: int, n_hashes: int) -> dict[str, DataFrame]:
    """Filters by kind. The filter of a node's content is built once and added up for its viewers."""
    content = cbf_build(placement, ["node_id"], "object_id", n_bits, n_hashes)
    leaf = lookup_join(content, neighbors.select("viewer", "node_id", "hop"), ["node_id"], small=is_small(neighbors))
    return {
        kind: leaf.groupBy(*keys, "pos").agg(F.sum("cnt").alias("cnt")) for kind, keys in LEVELS.items()
    }


def qf_tree(placement: DataFrame, neighbors: DataFrame, false_positive_rate: float) -> dict[str, DataFrame]:
    """Fingerprint filters by kind, each with the bits its volume asks for."""
    sizes = tree_sizes(neighbors, false_positive_rate)
    small = is_small(neighbors)
    near = lookup_join(placement, neighbors.select("viewer", "node_id", "hop"), ["node_id"], small=small)
    trees = {}
    for kind, keys in LEVELS.items():
        bits = sizes.where(F.col("kind") == kind).select(*keys, "bits")
        trees[kind] = qf_build(lookup_join(near, bits, keys, small=small), keys, "object_id", "bits")
    return trees


def _down_the_tree(probes: DataFrame, neighbors: DataFrame, small: bool, search) -> DataFrame:
    """Probes ``(viewer, object_id)`` from the root by the levels to the leaves.

    They are made distinct first, so no value of a filter is looked up twice and no key is hot.
    """
    at_root = search(probes.select("viewer", "object_id").distinct(), "root")
    levels = neighbors.select("viewer", "hop").distinct()
    at_level = search(lookup_join(at_root, levels, ["viewer"], small=small), "level")
    leaves = neighbors.select("viewer", "hop", "node_id")
    return search(lookup_join(at_level, leaves, ["viewer", "hop"], small=small), "leaf").select(
        "viewer", "object_id", "hop", "node_id"
    )


# Bit-sliced index of the filters of a tree: per viewer, word of 64 filters and position one bitmap that tells which
# filters have the position set. The AND over the positions of a value names all filters that answer.


def tree_slots(neighbors: DataFrame) -> DataFrame:
    """``(viewer, hop, node_id, word, bit, kind)``: the place of every filter in the bitmaps of its viewer."""
    rows = None
    for kind, keys in LEVELS.items():
        part = neighbors.select(*keys).distinct().select(
            "viewer", *[F.col(c) if c in keys else F.lit(None).cast("int").alias(c) for c in ("hop", "node_id")],
            F.lit(kind).alias("kind"),
        )
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy("viewer").orderBy(F.col("hop").asc_nulls_first(), F.col("node_id").asc_nulls_first())
    slot = F.row_number().over(order) - 1
    return rows.withColumn("_slot", slot).select(
        "viewer", "hop", "node_id", word_of(F.col("_slot")).alias("word"), F.col("_slot").bitwiseAND(63).alias("bit"), "kind"
    )


def sliced_index(tree: dict[str, DataFrame], slots: DataFrame) -> DataFrame:
    """``(viewer, word, pos, bits)``, from the leaves alone: what a leaf sets is set in its level and its root."""
    mask = bit_of(F.col("bit"))
    small = is_small(slots)
    ways = slots.where("kind = 'leaf'").select("viewer", "hop", "node_id", "word", mask.alias("mask"))
    for keys, kind in ((["viewer", "hop"], "level"), (["viewer"], "root")):
        above = slots.where(F.col("kind") == kind).select(*keys, "word", mask.alias("mask"))
        leaves = slots.where("kind = 'leaf'").select("viewer", "hop", "node_id")
        ways = ways.unionByName(leaves.join(above, keys).select("viewer", "hop", "node_id", "word", "mask"))
    masks = ways.groupBy("viewer", "hop", "node_id", "word").agg(F.bit_or("mask").alias("mask"))
    held = tree["leaf"].where("cnt > 0").select("viewer", "hop", "node_id", "pos")
    laid = lookup_join(held, masks, ["viewer", "hop", "node_id"], small=small)
    return laid.groupBy("viewer", "word", "pos").agg(F.bit_or("mask").alias("bits"))


class TreeIndex:
    """The index of a tree, stored once; up to FILTER_BYTES it is also packed to one array per viewer and word."""

    def __init__(self, tree: dict[str, DataFrame], neighbors: DataFrame, n_bits: int, n_hashes: int):
        self.n_bits, self.n_hashes = n_bits, n_hashes
        self.slots = stored(tree_slots(neighbors), "slots")
        self.rows = stored(sliced_index(tree, self.slots), "index")
        words = self.slots.select("viewer", "word").distinct()
        self.packed, self.count = None, words.count()
        if self.count * n_bits * 8 <= FILTER_BYTES:
            every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bits - 1).cast("bigint")))
            empty = words.select("viewer", "word", every.alias("pos"), F.lit(0).cast("bigint").alias("bits"))
            whole = self.rows.unionByName(empty).groupBy("viewer", "word", "pos").agg(F.bit_or("bits").alias("bits"))
            arrays = whole.groupBy("viewer", "word").agg(
                F.sort_array(F.collect_list(F.struct("pos", "bits")))["bits"].alias("slices")
            )
            number = F.row_number().over(Window.orderBy("viewer", "word")) - 1
            self.packed = stored(arrays.withColumn("_row", number), "slices")

    def answers(self, probes: DataFrame, value: str, by_viewer: bool) -> DataFrame:
        """Probes with ``(viewer, word, answer)``: the filters, of the probe's viewer or of all, that seem to hold the value.

        Packed arrays are broadcast, no probe moves, and the k lookups are plain array reads. Beyond that the
        positions of a probe meet the rows of the index.
        """
        places = bloom_positions(F.col(value), self.n_bits, self.n_hashes)
        others = [c for c in probes.columns if c != "viewer"]
        if self.packed is not None:
            keys = ["viewer"] if by_viewer else ["_row"]
            if not by_viewer:
                every = F.sequence(F.lit(0), F.lit(max(self.count - 1, 0)))
                probes = probes.select(*others, F.explode(every).alias("_row"))
            answer = functools.reduce(
                Column.bitwiseAND, [F.get("slices", F.get(places, F.lit(i)).cast("int")) for i in range(self.n_hashes)]
            )
            joined = probes.join(F.broadcast(self.packed), keys)
            return joined.select(*others, "viewer", "word", answer.alias("answer")).where("answer <> 0")
        laid = probes.withColumn("_places", F.array_distinct(places)).select(
            *probes.columns, F.size("_places").alias("_wanted"), F.explode("_places").alias("pos")
        )
        met = laid.join(self.rows, ["viewer", "pos"] if by_viewer else ["pos"])
        return met.groupBy(*others, "viewer", "word", "_wanted").agg(
            F.bit_and("bits").alias("answer"), F.count(F.lit(1)).alias("_met")
        ).where("_met = _wanted AND answer <> 0").select(*others, "viewer", "word", "answer")


def _bits_set(answer: str) -> Column:
    is_set = lambda i: F.call_function("shiftright", F.col(answer), i).bitwiseAND(1) == 1
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), is_set))


def cbf_tree_search(
    probes: DataFrame, tree: dict[str, DataFrame], neighbors: DataFrame, n_bits: int, n_hashes: int
) -> DataFrame:
    """``(viewer, object_id, hop, node_id)``: neighbours that seem to hold the object of a probe.

    Root, levels and leaves answer in one lookup; a leaf that answers has its level and root answer too.
    """
    index = TreeIndex(tree, neighbors, n_bits, n_hashes)
    found = index.answers(probes.select("viewer", "object_id").distinct(), "object_id", by_viewer=True)
    leaves = index.slots.where("kind = 'leaf'").select("viewer", "word", "bit", "hop", "node_id")
    named = found.select("viewer", "object_id", "word", _bits_set("answer").alias("bit"))
    return lookup_join(named, leaves, ["viewer", "word", "bit"]).select("viewer", "object_id", "hop", "node_id")


def qf_tree_search(
    probes: DataFrame, tree: dict[str, DataFrame], neighbors: DataFrame, false_positive_rate: float
) -> DataFrame:
    sizes = tree_sizes(neighbors, false_positive_rate)
    small = is_small(neighbors)

    def search(rows: DataFrame, kind: str) -> DataFrame:
        keys = LEVELS[kind]
        bits = sizes.where(F.col("kind") == kind).select(*keys, "bits")
        sized = lookup_join(rows, bits, keys, small=small)
        marked = sized.withColumn("fp", fingerprint(F.col("object_id"), F.col("bits")))
        return marked.join(_held(tree[kind], keys), [*keys, "fp"], "left_semi").drop("bits", "fp")

    return _down_the_tree(probes, neighbors, small, search)


def cbf_tree_fpr(
    negatives: DataFrame, tree: dict[str, DataFrame], neighbors: DataFrame, n_bits: int, n_hashes: int
) -> DataFrame:
    """``(viewer, root_fpr, level_fpr, all_fpr)`` over a list of objects nobody holds.

    Every negative is asked of all filters, 64 at once; each answer is a false hit.
    """
    index = TreeIndex(tree, neighbors, n_bits, n_hashes)
    total = negatives.agg(F.count(F.lit(1))).scalar()
    answers = index.answers(negatives.select("object_id"), "object_id", by_viewer=False)
    hits = answers.select("viewer", "word", _bits_set("answer").alias("bit")).groupBy("viewer", "word", "bit").agg(
        F.count(F.lit(1)).alias("_hits")
    )
    rates = stored(
        index.slots.join(hits, ["viewer", "word", "bit"], "left").select(
            "viewer", "hop", "node_id", "kind", (F.coalesce("_hits", F.lit(0)) / total).alias("fpr")
        ),
        "rates",
    )
    return _weigh({kind: rates.where(F.col("kind") == kind).select(*keys, "fpr") for kind, keys in LEVELS.items()})


def _weigh(rates: dict[str, DataFrame]) -> DataFrame:
    """Root rate, mean of root and levels, and mean of (mean leaf, root, that mean), per viewer."""
    levels = rates["level"].groupBy("viewer").agg(F.sum("fpr").alias("_levels"), F.count(F.lit(1)).alias("_n"))
    leaves = rates["leaf"].groupBy("viewer").agg(F.avg("fpr").alias("_leaves"))
    level = (F.col("_levels") + F.col("root_fpr")) / (F.col("_n") + 1)
    return (
        rates["root"].withColumnRenamed("fpr", "root_fpr")
        .join(levels, "viewer")
        .join(leaves, "viewer")
        .withColumn("level_fpr", level)
        .withColumn("all_fpr", (F.col("_leaves") + F.col("root_fpr") + F.col("level_fpr")) / 3)
        .select("viewer", "root_fpr", "level_fpr", "all_fpr")
    )


ENTRY_BYTES = 16


def stored_sizes(tree: dict[str, DataFrame]) -> DataFrame:
    """``(viewer, filters, entries, bytes)`` of the filter tables of a tree as they are: two whole numbers an entry."""
    rows = None
    for kind, keys in LEVELS.items():
        part = tree[kind].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("viewer", "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("viewer").agg(
        F.count(F.lit(1)).alias("filters"), F.sum("n").alias("entries"), (F.sum("n") * ENTRY_BYTES).alias("bytes")
    )

"""Near duplicates by MinHash bands and odd sketches.

A document's set is its distinct 5-word shingles. MinHash samples of the set are banded for candidates; the same
samples are folded into an odd sketch, a bitmap in which each sample flips one bit, so that the ones in the XOR
of two sketches count the samples in which two documents differ. Candidates that pass the sketch are confirmed
on the full sets.

Documents with equal sets are one class from the start, and only classes are compared. From large buckets those
go first that have too many shingles of their own to be linked with any member. Members of a bucket are not paired
with each other: they are compared with a hub, the one with the fewest shingles of its own; what is linked is one
component, and only what is still apart from the largest component of its bucket becomes a hub in later rounds.
A bucket is done when it has one component or all its minor members were hubs, so no pair that shares a bucket
and lies in two components stays unchecked.

In later rounds members are known by how they differ from the first hub r of their bucket: L, the shingles of r they lack, and E,
those they have and r has not. Both are short where a member is like r, and they tell the similarity of two members:
|a and b| = |r| - |L_a or L_b| + |E_a and E_b|. So the join of members with later hubs decides by itself and gives links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.llm.components import connected_components
from edgelake.llm.shingles import shingle_sets
from edgelake.llm.words import SHORT_SLICE_BYTES, mixed, slices
from edgelake.operators.scale import lookup_join, skew_join
from edgelake.session import scratch, stored

PERCENT = 75
BANDS = 40
BAND_ROWS = 5
ODD_WORDS = 8
ODD_MARGIN = 0.25
SMALL_BUCKET = 32
HUBS = 64
SHORT = 512
CHUNK = 4096
PART_SHINGLES = 1 << 20
LEAST_PARTS = 16
SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, odd array<bigint>"


def _samples(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions x -> factor * x + term, on 32 bits."""
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), CHUNK):
        hashed = np.multiply.outer(factors, values[at : at + CHUNK])
        hashed += terms[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return low


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = BANDS * BAND_ROWS
    seeds = mixed(np.arange(2 * k, dtype=np.uint64))
    factors, terms = (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> np.uint64(32)).astype(np.uint32)
    salts = mixed(np.arange(k, dtype=np.uint64) + np.uint64(1 << 40))
    for batch in batches:
        for low, high in slices(batch.column(1), SHORT_SLICE_BYTES):
            sets = shingle_sets(batch.column(1).slice(low, high - low))
            full = [s for s in sets if len(s)]
            sizes = np.array([len(s) for s in sets], np.int64)
            sums = np.zeros((2, len(sets)), np.uint64)
            bands, odd = np.zeros((len(full), BANDS), np.int64), np.zeros((len(full), ODD_WORDS), np.uint64)
            if full:
                flat, at = np.concatenate(full), np.cumsum([0, *map(len, full)])[:-1]
                for i, salt in enumerate((np.uint64(1), np.uint64(2))):
                    sums[i, sizes > 0] = np.add.reduceat(mixed(flat ^ salts[i] ^ salt), at)
                samples = np.stack([_samples(s, factors, terms) for s in full]).astype(np.uint64)
                marked = mixed(samples ^ salts)
                parts = marked.reshape(len(full), BANDS, BAND_ROWS)
                keys = np.zeros((len(full), BANDS), np.uint64)
                for r in range(BAND_ROWS):
                    keys = mixed(keys ^ parts[:, :, r])
                bands = keys.view(np.int64)
                bits = marked % np.uint64(64 * ODD_WORDS)
                for j in range(k):
                    word = (bits[:, j] >> np.uint64(6)).astype(np.int64)
                    odd[np.arange(len(full)), word] ^= np.uint64(1) << (bits[:, j] & np.uint64(63))
            lists = np.where(sizes > 0, 1, 0).cumsum()
            offsets = np.concatenate([[0], lists]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low),
                    pa.array(sizes),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets * BANDS), pa.array(bands.ravel())),
                    pa.ListArray.from_arrays(pa.array(offsets * ODD_WORDS), pa.array(odd.view(np.int64).ravel())),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "odd"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(batch.column(1), SHORT_SLICE_BYTES):
            sets = shingle_sets(batch.column(1).slice(low, high - low))
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["node", "shingles"],
            )


def _dealt_shingles(parts: int):
    """Shingles of nodes in lists, one per slice and part; what a slice has more than once is listed twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high in slices(batch.column(1), SHORT_SLICE_BYTES):
                sets = shingle_sets(batch.column(1).slice(low, high - low))
                flat, node = np.concatenate(sets), np.repeat(ids[low:high], [len(s) for s in sets])
                order = np.argsort(flat, kind="stable")
                flat, node = flat[order], node[order]
                few = np.ones(len(flat), bool)
                few[2:] = flat[2:] != flat[:-2]
                flat, node = flat[few], node[few]
                part = (flat % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                found, first = np.unique(part[order], return_index=True)
                offsets = pa.array(np.append(first, len(part)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (flat.view(np.int64), node)]
                yield pa.RecordBatch.from_arrays([pa.array(found), *lists], ["part", "shingles", "nodes"])

    return run


def _private(table: pa.Table) -> pa.Table:
    """Nodes of a part with the number of its shingles that no other node has."""
    shingles, nodes = (pa.concat_arrays([c.flatten() for c in table.column(name).chunks]).to_numpy() for name in ("shingles", "nodes"))
    order = np.argsort(shingles)
    edges = np.ones(len(order) + 1, bool)
    edges[1:-1] = np.diff(shingles[order]) != 0
    node, count = np.unique(nodes[order[edges[:-1] & edges[1:]]], return_counts=True)
    return pa.table({"node": pa.array(node, pa.int64()), "private": pa.array(count, pa.int64())})


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketch of every row: doc_id, n_shingles, set_a and set_b (sums over the set), band keys, odd sketch."""
    return _texts(docs, id_col, text_col).mapInArrow(_sketches, SKETCH)


def odd_similarity(a: Column, b: Column) -> Column:
    """Similarity that two odd sketches show, -1 where they differ in too many bits to tell."""
    bits, samples = 64.0 * ODD_WORDS, float(BANDS * BAND_ROWS)
    ones = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = -bits / 2 * F.log(1 - 2 * ones / bits)
    return F.when(2 * ones < bits, 1 - apart / (2 * samples)).otherwise(-1.0)


def _promising(n_a: Column, n_b: Column, odd_a: Column, odd_b: Column, percent: int) -> Column:
    """Whether sizes allow the similarity and the odd sketches show it, less a margin of about six deviations."""
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent
    return sizes & (odd_similarity(odd_a, odd_b) >= percent / 100 - ODD_MARGIN)


def _with_sets(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and odd sketches allow, with the full sets of both: a, b, s_a, s_b, common."""
    own = nodes.select("node", "n_shingles", "odd")
    a = own.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("odd").alias("odd_a"))
    b = own.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("odd").alias("odd_b"))
    asked = (
        pairs.join(b, "b")
        .join(a, "a")
        .where(_promising(F.col("n_a"), F.col("n_b"), F.col("odd_a"), F.col("odd_b"), percent))
        .select("a", "b")
        .distinct()
    )
    asked = stored(asked, "asked")
    ends = asked.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = lookup_join(docs, ends, ["doc_id"], "left_semi")
    sets = stored(needed.mapInArrow(_full_sets, "node bigint, shingles array<bigint>"), "sets")
    both = asked.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a"
    )
    return both.withColumn("common", F.size(F.array_intersect("s_a", "s_b")))


def _enough(common: Column, union: Column, percent: int) -> Column:
    return common * 100 >= union * percent


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, after the sizes and the odd sketches are asked."""
    both = _with_sets(pairs, nodes, docs, percent)
    union = F.size("s_a") + F.size("s_b") - F.col("common")
    return both.where(_enough(F.col("common"), union, percent)).select("a", "b").distinct()


def _differences(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Differences of nodes from hubs, of the pairs (hub, node) that sizes and sketches allow: hub, node, size, linked, lacks, extra.

    ``size`` is the number of shingles of the hub. Of nodes with several texts (one id, several rows) and where more
    than SHORT shingles differ there are none.
    """
    both = _with_sets(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")), nodes, docs, percent)
    union = F.size("s_a") + F.size("s_b") - F.col("common")
    lacks, extra = F.array_except("s_a", "s_b"), F.array_except("s_b", "s_a")
    short = F.size("s_a") + F.size("s_b") - 2 * F.col("common") <= SHORT
    found = both.groupBy(F.col("a").alias("hub"), F.col("b").alias("node")).agg(
        F.max(_enough(F.col("common"), union, percent)).alias("linked"),
        F.count(F.lit(1)).alias("texts"),
        F.first(F.size("s_a")).alias("size"),
        F.first(F.when(short, lacks)).alias("lacks"),
        F.first(F.when(short, extra)).alias("extra"),
    )
    single = F.col("texts") == 1
    return found.select(
        "hub", "node", "size", "linked", F.when(single, F.col("lacks")).alias("lacks"), F.when(single, F.col("extra")).alias("extra")
    )


def _by_differences(a: str, b: str, percent: int) -> Column:
    """Whether two nodes of one hub are linked, from their differences; null where these are not known."""
    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def n(side: str, name: str) -> Column:
        return F.size(of(side, name))

    same = F.size(F.array_intersect(of(a, "lacks"), of(b, "lacks"))) + F.size(F.array_intersect(of(a, "extra"), of(b, "extra")))
    common = of(a, "size") - n(a, "lacks") - n(b, "lacks") + same
    total = 2 * of(a, "size") - n(a, "lacks") - n(b, "lacks") + n(a, "extra") + n(b, "extra")
    known = of(a, "lacks").isNotNull() & of(b, "lacks").isNotNull()
    return F.when(known, _enough(common, total - common, percent))


def _not_alone(members: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Members (key, node, n) of buckets without those that can be linked with none of their bucket: key, node, private.

    ``private`` counts the shingles of a node that no other node of a large bucket has. What a node with n shingles
    shares with another is at most c = n - private, so their similarity is at most c / (m + private), m being the
    least set of the bucket, or c / n if that is smaller than c. This is exact, and linear in the sets of large
    buckets; small ones are left as they are. Shingles are dealt by their value over parts of about PART_SHINGLES and travel in lists.
    """
    big = members.where(F.col("n") > SMALL_BUCKET)
    own = stored(big.select(F.col("node").alias("doc_id")).distinct(), "big")
    plain = members.select("key", "node", F.lit(0).cast("bigint").alias("private"))
    if own.isEmpty():
        return plain
    sizes = nodes.groupBy("node").agg(F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("texts"), F.sum("n_shingles").alias("all"))
    sizes = stored(sizes.join(own.withColumnRenamed("doc_id", "node"), "node", "left_semi"), "sizes")
    parts = max(LEAST_PARTS, (sizes.agg(F.sum("all")).first()[0] or 0) // PART_SHINGLES)
    lists = lookup_join(docs, own, ["doc_id"], "left_semi").mapInArrow(
        _dealt_shingles(parts), "part bigint, shingles array<bigint>, nodes array<bigint>"
    )
    private = lists.groupBy("part").applyInArrow(_private, "node bigint, private bigint")
    private = private.groupBy("node").agg(F.sum("private").alias("private"))
    known = stored(
        sizes.join(private, "node", "left")
        .select("node", "size", F.when(F.col("texts") == 1, F.coalesce("private", F.lit(0))).otherwise(0).alias("private")),
        "private",
    )
    large = big.select("key", "node").join(known, "node")
    least = large.groupBy("key").agg(F.min("size").alias("least"))
    shared = F.col("size") - F.col("private")
    most = F.when(F.col("least") >= shared, F.col("least") + F.col("private")).otherwise(F.col("size"))
    linkable = large.join(least, "key").where(shared * 100 >= most * percent).select("key", "node", "private")
    return plain.join(big.select("key").distinct(), "key", "left_anti").unionByName(linkable)


def _linked(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Nodes that are linked with others, with their component: node, component."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("_first"), F.max("node").alias("_last")
    ).where("_first < _last")
    spark = nodes.sparkSession
    with scratch(spark) as outlive:
        found = stored(bands.join(shared.select("key", "n"), "key"), "buckets")
        members = outlive(_not_alone(found, nodes, docs, percent), "members")
    middle = members.groupBy("key").agg(F.min(F.struct("private", "node"))["node"].alias("hub"), F.count(F.lit(1)).alias("size"))
    placed = stored(members.join(middle, "key").select("key", "node", "hub", "size"), "placed")
    pair = (F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    tested = stored(placed.where("node <> hub").select(*pair).distinct(), "pairs")
    members = placed.where("size > 2").select("key", "node", F.col("hub").alias("r"))
    waiting = placed.where("size > 2 AND node <> hub").select("key", "node")
    from_hubs = placed.where("node <> hub").select("hub", "node").distinct()
    with scratch(spark) as outlive:
        apart = outlive(_differences(from_hubs, nodes, docs, percent), "differences")
    links = stored(apart.where("linked").select(*pair).distinct(), "links")
    with scratch(spark) as outlive:
        labels = outlive(connected_components(links), "labels")
    differ = F.struct(F.col("hub").alias("r"), "size", "lacks", "extra")
    known = stored(
        nodes.select("node", F.col("n_shingles").alias("n"), "odd", "bands")
        .join(apart.groupBy("node").agg(F.collect_list(differ).alias("differences")), "node", "left"),
        "known",
    )

    def placed_again(rows: DataFrame) -> DataFrame:
        """Rows (key, r, node, component) with what is known of the node, by a join of one row per node."""
        at = rows.groupBy("node", "component").agg(F.collect_list(F.struct("key", "r")).alias("places"))
        each = at.join(known, "node").select("node", "component", "n", "odd", "bands", "differences", F.explode("places").alias("at"))
        of_hub = F.get(F.filter("differences", lambda d: d["r"] == F.col("at.r")), F.lit(0))
        return each.select("node", "component", "n", "odd", "bands", "at.key", of_hub.alias("d")).select(
            "node", "component", "n", "odd", "bands", "key", "d.size", "d.lacks", "d.extra"
        )

    width = HUBS
    while True:
        with scratch(spark) as outlive:
            label = F.coalesce("component", "node")
            own = members.join(labels, "node", "left").select("key", "node", "r", label.alias("component"))
            counts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
            tops = counts.groupBy("key").agg(
                F.max(F.struct("n", "component"))["component"].alias("top"), F.count(F.lit(1)).alias("parts")
            ).where("parts > 1")
            open_ = stored(own.join(tops.select("key", "top"), "key"), "open")
            minor = open_.where("component <> top").join(waiting, ["key", "node"], "left_semi")
            turn = F.xxhash64(F.lit(width), "key", "node")
            hubs = minor.groupBy("key", F.pmod(turn, F.lit(width)).alias("_slot")).agg(
                F.min(F.struct(turn.alias("t"), "node", "component", "r")).alias("h")
            )
            hubs = stored(hubs.select("key", "h.node", "h.component", "h.r"), "hubs")
            if hubs.isEmpty():
                return labels
            left = placed_again(open_.select("key", "r", "node", "component"))
            right = placed_again(hubs).withColumnsRenamed(
                {"node": "hub", "component": "hub_component", "n": "h_n", "odd": "h_odd", "bands": "h_bands"}
            )
            equal = F.zip_with("bands", "h_bands", lambda x, y: x == y)
            first = F.element_at("bands", F.array_position(equal, True).cast("int"))
            ask = (
                (F.col("component") != F.col("hub_component"))
                & (first == F.col("l.key"))
                & _promising(F.col("n"), F.col("h_n"), F.col("odd"), F.col("h_odd"), percent)
            )
            by_differences = _by_differences("l", "r", percent)
            ask = ask & F.coalesce(by_differences, F.lit(True))
            met = stored(
                left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & ask)
                .select(*pair, by_differences.isNotNull().alias("linked")).distinct(),
                "met",
            )
            pairs = outlive(met.where("NOT linked").select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
            found = stored(
                _confirmed(pairs, nodes, docs, percent).unionAll(met.where("linked").select("a", "b")).distinct(), "found"
            )
            if not found.isEmpty():
                links = outlive(links.unionAll(found), "links")
                labels = outlive(connected_components(links), "labels")
            tested = tested.unionAll(pairs)
            used = hubs.select("key", "node")
            waiting = outlive(waiting.join(used, ["key", "node"], "left_anti"), "waiting")
            width *= HUBS


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Groups of near duplicates: one row per row of ``docs``.

    Columns: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (doc_id is that).
    Null, empty and blank texts have no shingles and are linked with nothing. Rows of one doc_id are one
    document, linked by any of its texts. A null doc_id is returned with a null component and kept. No rows
    give no rows; other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    key = ["n_shingles", "set_a", "set_b"]
    with scratch(docs.sparkSession) as outlive:
        full = stored(sketches(docs, id_col, text_col), "sketches")
        rows = outlive(full.select("doc_id", *key), "sets")
        named = full.where("doc_id IS NOT NULL AND n_shingles > 0")
        nodes = stored(
            named.groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("odd").alias("odd")),
            "nodes",
        )
        again = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        same = named.join(again, "doc_id", "left_semi").join(nodes.select(*key, "node"), key)
        edges = stored(same.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "edges")
        labels = _linked(nodes, texts, percent)
        if not edges.isEmpty():
            linked = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = connected_components(linked.unionAll(edges))
        classes = nodes.select(*key, "node").join(labels, "node", "left").select(
            *key, F.coalesce("component", "node").alias("component_id")
        )
        classes = outlive(classes.distinct(), "classes")
    placed = skew_join(rows, classes, key, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.col("doc_id").eqNullSafe(F.when(F.col("doc_id").isNotNull(), component)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest id, and all its columns.

    Of rows of one id one stays. Rows without an id and texts without words are in no group and stay.
    """
    with scratch(docs.sparkSession) as outlive:
        groups = outlive(near_duplicates(docs, id_col, text_col, percent), "groups")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("bigint").alias("_id"))
    dropped = stored(groups.where("NOT kept").select(F.col("doc_id").alias("_id")).distinct(), "dropped")
    left = lookup_join(rows, dropped, ["_id"], "left_anti").select("_row", "_id")
    again = groups.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    again = stored(again.where("n > 1").select("_id"), "again")
    if again.isEmpty():
        return left.select("_row.*")
    single = lookup_join(left, again, ["_id"], "left_anti").select("_row", "_id")
    one = lookup_join(left, again, ["_id"], "left_semi").select("_row", "_id").dropDuplicates(["_id"])
    return single.unionByName(one).select("_row.*")

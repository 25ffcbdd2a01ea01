"""Benchmark decontamination by spaced-seed hashing.

A text overlaps a test item when 13 words of it stand against 13 words of the item, in order and without gaps, and
at most 2 of them differ. Seeds hash the words that a fixed mask keeps and ignore the others; with the masks
below every window of 13 words with 2 substitutions or fewer has a seed that misses both, so the hash join loses
no overlap, and what it finds is confirmed word by word around each hit. Items shorter than a window are found
as a whole, word for word; items of fewer than 5 words are not searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.llm.words import SHORT_SLICE_BYTES, mixed, slices, window_hashes, windows, words_of
from edgelake.operators.scale import lookup_join
from edgelake.session import scratch, stored

WINDOW = 13
SUBSTITUTIONS = 2
MASKS = ("111011101", "1110100111", "1001110111")
SHORT_SUBSTITUTIONS = 1
SOLID_ITEM = 4
BITS_PER_SEED = 64
MOST_BITS = 1 << 28
PROBES = 4


def _masks() -> list[tuple[int, list[int]]]:
    """Masks as (words of the items they are for, offsets of the words they keep).

    Items of WINDOW words or more have the spaced masks (their number of words is given as 0). Shorter ones have two, the first
    and the second half of their words, one of which is whole where one word was changed; items of up to SOLID_ITEM words are looked
    for as they are.
    """
    out = [(0, [i for i, c in enumerate(mask) if c == "1"]) for mask in MASKS]
    for n in range(1, WINDOW):
        halves = [range(n)] if n <= SOLID_ITEM else [range(n // 2), range(n // 2, n)]
        out += [(n, list(half)) for half in halves]
    return out


def _seeds(hashes: np.ndarray, first: np.ndarray, number: int, offsets: list[int]):
    """Starts, texts and hashes of all places of a mask; the mask's number is part of the hash."""
    starts, doc = windows(first, offsets[-1] + 1)
    return starts, doc, mixed(window_hashes(hashes, starts, offsets) + np.uint64(number))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item with the hashes of its words and its seeds."""
    masks = _masks()
    for batch in batches:
        words = words_of(batch.column(1), lower=True)
        hashes, first = words.hashes(), words.first
        rows = {"item_id": batch.column(0).to_pylist(), "words": [], "seeds": []}
        for i in range(batch.num_rows):
            own = hashes[first[i] : first[i + 1]]
            span = np.array([0, len(own)])
            found = []
            for number, (length, offsets) in enumerate(masks):
                if len(own) == length or not length and len(own) >= WINDOW:
                    starts, _, seeds = _seeds(own, span, number, offsets)
                    places = zip(seeds.view(np.int64), starts)
                    found += [{"seed": int(s), "at": int(p)} for s, p in places if not length or p == 0]
            rows["words"].append(own.view(np.int64))
            rows["seeds"].append(found)
        yield pa.RecordBatch.from_pydict(rows, schema=_ITEM)


_ITEM = pa.schema([
    ("item_id", pa.int64()),
    ("words", pa.list_(pa.int64())),
    ("seeds", pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))),
])
_REGION = pa.schema([
    ("doc_id", pa.int64()),
    ("text_key", pa.int64()),
    ("begin", pa.int32()),
    ("words", pa.list_(pa.int64())),
    ("hits", pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))),
])


def _in_filter(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the seeds whose bits are all set; each probe looks only at what the one before let through."""
    places = np.arange(len(seeds))
    most = np.uint64(len(bits) * 64 - 1)
    for probe in range(PROBES):
        at = _bit(seeds[places], probe) & most
        places = places[(bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return places


def _bit(seeds: np.ndarray, probe: int) -> np.ndarray:
    return mixed(seeds + np.uint64(probe + 1))


def _regions(lengths: list[int], bits) -> object:
    """Parts of texts around places where a seed passes the filter, with the seeds found there."""
    masks = _masks()
    used = [(n, m) for n, (length, m) in enumerate(masks) if not length or length in lengths]
    margin = WINDOW - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2), SHORT_SLICE_BYTES):
                words = words_of(batch.column(2).slice(low, high - low), lower=True)
                hashes, first = words.hashes(), words.first
                hits = []
                for number, offsets in used:
                    starts, doc, seeds = _seeds(hashes, first, number, offsets)
                    passed = _in_filter(seeds, bits.value)
                    hits.append((starts[passed], doc[passed], seeds[passed], np.full(len(passed), offsets[-1])))
                at, doc, seed, span = (np.concatenate(x) for x in zip(*hits))
                if not len(at):
                    continue
                order = np.lexsort((seed, at))
                at, doc, seed, span = at[order], doc[order], seed[order], span[order]
                begin, end = np.maximum(at - margin, first[doc]), np.minimum(at + span + margin + 1, first[doc + 1])
                reach = np.maximum.accumulate(end)
                new = np.ones(len(at), bool)
                new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
                cuts = np.flatnonzero(new).tolist() + [len(at)]
                ids, keys = batch.column(0), batch.column(1)
                rows: dict[str, list] = {name: [] for name in _REGION.names}
                for a, b in zip(cuts, cuts[1:]):
                    base = int(begin[a])
                    rows["doc_id"].append(ids[low + int(doc[a])].as_py())
                    rows["text_key"].append(keys[low + int(doc[a])].as_py())
                    rows["begin"].append(base - int(first[doc[a]]))
                    rows["words"].append(hashes[base : int(reach[b - 1])].view(np.int64))
                    rows["hits"].append([
                        {"seed": s, "at": p} for s, p in zip(seed[a:b].view(np.int64).tolist(), (at[a:b] - base).tolist())
                    ])
                yield pa.RecordBatch.from_pydict(rows, schema=_REGION)

    return scan


def _filter_bits(seeds: DataFrame) -> np.ndarray:
    """Bitmap of the test seeds, at most MOST_BITS; built by Spark, the driver gets words that are not zero."""
    count = seeds.count()
    size = 1 << max(10, min(MOST_BITS, max(1, count) * BITS_PER_SEED) - 1).bit_length()
    size = min(size, MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.concatenate([_bit(own, p) & np.uint64(size - 1) for p in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["bit"])

    one = F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
    found = (
        seeds.select("seed").mapInArrow(places, "bit bigint")
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Confirmed overlaps: doc_id, text_key, item_id, doc_word and item_word where the overlap's aligned words begin,
    matched (equal words) and aligned (words that stand against each other in the part looked at)."""
    spark = docs.sparkSession
    tests = stored(
        items.select(F.col(item_id_col).cast("bigint"), F.col(item_text_col)).mapInArrow(
            _item_words,
            "item_id bigint, words array<bigint>, seeds array<struct<seed:bigint,at:int>>",
        ),
        "items",
    ).withColumn("item", F.monotonically_increasing_id())
    tests = stored(tests, "items")
    seeds = tests.select("item", F.explode("seeds").alias("s")).select("item", "s.seed", F.col("s.at").alias("item_at"))
    seeds = stored(seeds, "seeds")
    lengths = [r[0] for r in tests.groupBy(F.size("words").alias("n")).count().where(F.col("n").between(1, WINDOW - 1)).collect()]
    bits = spark.sparkContext.broadcast(_filter_bits(seeds))
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")
    )
    regions = keyed.mapInArrow(
        _regions(lengths, bits),
        "doc_id bigint, text_key bigint, begin int, words array<bigint>, hits array<struct<seed:bigint,at:int>>",
    )
    regions = stored(regions, "regions")
    place = F.xxhash64("doc_id", "text_key", "begin").alias("region")
    hits = stored(
        regions.select(place, F.explode("hits").alias("h")).select("region", "h.seed", F.col("h.at").alias("at")), "hits"
    )
    lines = lookup_join(hits, seeds, ["seed"]).select("region", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    own = regions.select("doc_id", "text_key", "begin", "words", place)
    both = lookup_join(
        lines.join(own, "region"), tests.select("item", "item_id", F.col("words").alias("item_words")), ["item"]
    )
    low = F.greatest(F.col("shift"), F.lit(0))
    high = F.least(F.size("words"), F.col("shift") + F.size("item_words"))
    same = F.transform(
        F.sequence(low, high - 1),
        lambda p: (F.get("words", p) == F.get("item_words", p - F.col("shift"))).cast("int"),
    )
    width = F.least(F.lit(WINDOW), F.size("item_words"))
    allowed = (
        F.when(F.size("item_words") <= SOLID_ITEM, 0).when(F.size("item_words") < WINDOW, SHORT_SUBSTITUTIONS).otherwise(SUBSTITUTIONS)
    )
    add = lambda s, x: s + x
    enough = F.exists(
        F.sequence(F.lit(1), F.size("same") - width + 1),
        lambda p: F.aggregate(F.slice("same", p, width), F.lit(0), add) >= width - allowed,
    )
    return (
        both.where(high > low)
        .withColumn("same", same)
        .where((F.size("same") >= width) & enough)
        .select(
            "doc_id",
            "text_key",
            "item_id",
            (F.col("begin") + low).alias("doc_word"),
            (low - F.col("shift")).alias("item_word"),
            F.aggregate("same", F.lit(0), add).alias("matched"),
            F.size("same").alias("aligned"),
        )
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with the items it overlaps: doc_id, text_key (a hash of the text), items (sorted ids,
    empty if none), kept.

    Null and empty texts overlap nothing, and null or empty items find nothing; an item with a null id counts
    but is not listed. Repeated rows stay repeated and are judged alike, null ids too. No rows give no rows, no
    items keep all. Other columns are not read.
    """
    with scratch(docs.sparkSession) as outlive:
        found = overlaps(docs, items, id_col, text_col, item_id_col, item_text_col)
        per_doc = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        per_doc = outlive(per_doc, "leaks")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"))
    leaks = per_doc.select(*_identity(F.col("doc_id"), F.col("text_key")), "items")
    joined = lookup_join(rows.select("*", *_identity(F.col("doc_id"), F.col("text_key"))), leaks, IDENTITY, "left")
    return joined.select(
        "doc_id",
        "text_key",
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.col("items").isNull().alias("kept"),
    )


def drop_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows whose text overlaps a test item, with all their columns."""
    with scratch(docs.sparkSession) as outlive:
        found = overlaps(docs, items, id_col, text_col, item_id_col, item_text_col)
        leaks = outlive(found.select(*_identity(F.col("doc_id"), F.col("text_key"))).distinct(), "leaks")
    own = _identity(F.col(id_col).cast("bigint"), F.xxhash64(F.col(text_col)))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *own)
    return lookup_join(rows, leaks, IDENTITY, "left_anti").select("_row.*")


IDENTITY = ["_no_id", "_id", "_text"]


def _identity(id_: Column, text_key: Column) -> list[Column]:
    """Columns to join rows on by id and text, null ids among each other."""
    return [id_.isNull().alias("_no_id"), F.coalesce(id_, F.lit(0)).alias("_id"), text_key.alias("_text")]

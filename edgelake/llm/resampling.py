"""Resampling of documents towards a target distribution of hashed n-grams, by importance weights.

Words are cut by everything that is no digit, letter or character beyond ASCII, so newlines cut texts into lines that share no
word. The features of a text (its words and pairs of consecutive words) are then those of its lines and the pairs
across lines. A line that occurs many times is counted once: its features are hashed once, and their counts are
multiplied by its occurrences; the pairs across lines are added text by text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgelake.llm.positions import numbered
from edgelake.llm.words import Words, slices, words_of
from edgelake.session import stored

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
SHORT_WORD = 24
_ONES = np.uint32(0xFFFFFFFF)


def _crc_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _crc_steps()
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[97:123] = _TERM[128:] = True


def terms_of(texts: pa.Array) -> Words:
    return words_of(texts, lower=True, of=_TERM)


def _crc(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """States of running checksums (inverted crc32) after the bytes at ``starts``."""
    state = state.copy()
    rows = np.arange(len(starts))
    for i in range(min(int(sizes.max(initial=0)), SHORT_WORD)):
        rows = rows[sizes[rows] > i]
        old = state[rows]
        state[rows] = _STEPS[(old ^ data[starts[rows] + i]) & np.uint32(255)] ^ (old >> np.uint32(8))
    for row in np.flatnonzero(sizes > SHORT_WORD).tolist():
        rest = data[starts[row] + SHORT_WORD : starts[row] + sizes[row]].tobytes()
        state[row] = zlib.crc32(rest, int(state[row] ^ _ONES)) ^ int(_ONES)
    return state


def _buckets(words: Words, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of features, and the text of each: of all words and pairs, or of the pairs that begin at ``firsts``."""
    sizes = words.ends - words.starts
    singles = firsts is None
    if singles:
        firsts = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    heads = np.arange(len(sizes)) if singles else firsts
    state = _crc(np.full(len(heads), _ONES), words.data, words.starts[heads], sizes[heads])
    spaced = state[firsts] if singles else state
    spaced = _STEPS[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8))
    pairs = _crc(spaced, words.data, words.starts[firsts + 1], sizes[firsts + 1])
    found = np.concatenate([state, pairs]) if singles else pairs
    doc = np.concatenate([words.doc, words.doc[firsts]]) if singles else words.doc[firsts]
    order = np.argsort(doc, kind="stable")
    return ((found ^ _ONES) % np.uint32(BUCKETS)).astype(np.int32)[order], doc[order]


def _lists(values: np.ndarray, of: np.ndarray, rows: int) -> pa.Array:
    """A list per row, from flat values and the row of each, ascending."""
    offsets = np.searchsorted(of, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _crossing(words: Words) -> np.ndarray:
    """Words that are the last of their line and have a next word in their text."""
    breaks = np.flatnonzero(words.data == 10)
    apart = np.searchsorted(breaks, words.ends[:-1]) < np.searchsorted(breaks, words.starts[1:])
    return np.flatnonzero(apart & (words.doc[1:] == words.doc[:-1]))


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the distinct keys of its lines, how often each occurs, and the buckets of the pairs across lines."""
    for batch in batches:
        for low, high in slices(batch.column(1)):
            n = high - low
            across, doc = _buckets(words := terms_of(batch.column(1).slice(low, n)), _crossing(words))
            lists = [batch.column(i).slice(low, n) for i in (2, 3)]
            a, b = (x.flatten().to_numpy() for x in lists)
            of = np.repeat(np.arange(n), lists[0].value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((b, a, of))
            a, b, of = a[order], b[order], of[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(a)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, n), _lists(across, doc, n), *[_lists(x, of[at], n) for x in (a[at], b[at], times)]],
                ["doc_id", "across", "a", "b", "times"],
            )


def _line_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(batch.column(0)):
            found, of = _buckets(terms_of(batch.column(0).slice(low, high - low)))
            others = [batch.column(i).slice(low, high - low) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*others, _lists(found, of, high - low)], ["a", "b", "n", "buckets"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features per bucket in lists that count ``n`` times: one row per bucket and task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        np.add.at(total, batch.column(1).flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), sizes))
    kept = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], ["bucket", "n"])


class Features:
    """Features of texts in two stored tables: ``texts`` (a row per text) and ``lines`` (a row per distinct line)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
        lines = F.filter(F.split("text", "\n"), lambda line: line != "")
        keyed = rows.select(
            "doc_id", "text", F.transform(lines, _key_a).alias("a"), F.transform(lines, _key_b).alias("b")
        )
        outline = "doc_id bigint, across array<int>, a array<bigint>, b array<bigint>, times array<bigint>"
        self.texts = numbered(keyed.mapInArrow(_outline, outline), "texts", "row")
        distinct = rows.select(F.explode(lines).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        counted = distinct.select("line", _key_a(F.col("line")).alias("a"), _key_b(F.col("line")).alias("b"), "n")
        self.lines = stored(
            counted.mapInArrow(_line_buckets, "a bigint, b bigint, n bigint, buckets array<int>"), "lines"
        )

    def counts(self) -> DataFrame:
        """Features per bucket over all texts: bucket, n."""
        weighed = self.lines.select("n", "buckets").unionAll(self.texts.select(F.lit(1).cast("bigint"), "across"))
        found = weighed.mapInArrow(_totals, "bucket bigint, n bigint")
        return found.groupBy("bucket").agg(F.sum("n").alias("n"))

    def sums(self, gains: np.ndarray) -> DataFrame:
        """Per text the number of its features and the sum of their gains: row, doc_id, n_features, gain.

        A line with more than one part in P of all lines (P = shuffle partitions; fewer than P lines are) is looked
        up by a broadcast, so that no task receives all texts of a frequent line.
        """

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(gains[batch.column(0).flatten().to_numpy()])])
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sums[ends] - sums[ends - sizes]), pa.array(sizes), *batch.columns[1:]],
                    ["gain", "n_features", *batch.schema.names[1:]],
                )

        across = self.texts.select("across", "row", "doc_id").mapInArrow(
            added, "gain bigint, n_features bigint, row bigint, doc_id bigint"
        )
        lines = stored(
            self.lines.select("buckets", "a", "b", "n").mapInArrow(
                added, "gain bigint, n_features bigint, a bigint, b bigint, n bigint"
            ),
            "gains",
        )
        total = lines.agg(F.sum("n")).first()[0] or 0
        parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot = lines.where(F.col("n") * parts > total).drop("n")
        held = self.texts.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("l")).select("row", "l.*")
        found = [
            held.join(F.broadcast(hot), ["a", "b"]),
            held.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(lines, ["a", "b"]),
        ]
        none = F.lit(None).cast("bigint").alias("doc_id")
        parts_of = across.select("row", "doc_id", "gain", "n_features")
        for some in found:
            parts_of = parts_of.unionAll(
                some.select("row", none, F.col("gain") * F.col("times"), F.col("n_features") * F.col("times"))
            )
        return parts_of.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.sum("n_features").alias("n_features"), F.sum("gain").alias("gain")
        )


def _key_a(line: Column) -> Column:
    return F.xxhash64(line)


def _key_b(line: Column) -> Column:
    return F.xxhash64(F.lit(1), line)


def bucket_gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the raw texts."""
    spark = raw.sparkSession
    known = spark.range(BUCKETS).select(F.col("id").alias("bucket"))
    for name, counts in (("s", raw), ("t", target)):
        known = known.join(counts.select("bucket", F.col("n").alias(name)), "bucket", "left").fillna(0, [name])
    known = stored(known, "buckets")
    sums = known.agg(F.sum("s").cast("double").alias("s_all"), F.sum("t").cast("double").alias("t_all"))
    s, t = (F.col(c).cast("double") + 1.0 for c in ("s", "t"))
    ratio = t * (F.col("s_all") + float(BUCKETS)) / (s * (F.col("t_all") + float(BUCKETS)))
    found = known.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.log(ratio) * 1000.0).cast("bigint").alias("gain"))
    gains = np.zeros(BUCKETS, np.int64)
    for row in found.collect():
        gains[row["bucket"]] = row["gain"]
    return gains


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words, without replacement, by importance.

    Returns per row doc_id, n_features, weight (floored mean of the gains of its features), score (weight plus
    Gumbel noise of the id, in thousandths) and rank (from 1 by falling score; null where not drawn). Equal scores
    go to the smaller id, a null id last; rows of one id have the same noise, and equal rows of one id change places freely.
    Null and empty texts have no features, weight 0, and are not drawn. An empty target has the smoothed share 1 /
    BUCKETS everywhere. No rows give no rows; other columns are not read. Lines are compared by 128 bits of hash; a
    line of any length is one row.
    """
    raw = Features(docs, id_col, text_col)
    wanted = Features(target.select(F.lit(0).alias("doc_id"), F.col(target_text_col).alias("text")), "doc_id", "text")
    gains = bucket_gains(raw.counts(), wanted.counts())
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("bigint")
    weight = F.expr("CASE WHEN n_features > 0 THEN (gain - pmod(gain, n_features)) DIV n_features ELSE 0 END")
    scored = stored(
        raw.sums(gains).select("row", "doc_id", "n_features", weight.cast("bigint").alias("weight"))
        .withColumn("score", F.col("weight") + noise),
        "scored",
    )
    enough = F.col("n_features") >= 2 * least_words - 1
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = scored.where(enough).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = numbered(sorted_, "ranked", "place")
    drawn = scored.where(enough).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    rest = scored.where(~enough).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, rank).unionAll(rest)

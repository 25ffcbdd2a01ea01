"""Repeated line runs by a suffix array over sequences of line ids.

Every text is a sequence of line ids. Suffixes are ranked by prefix doubling: a round orders them by twice as many
lines as the last, from the rank a suffix has and the rank of the suffix so many lines on. Only suffixes that
still share their rank with others take part in a round. Adjacent suffixes get their longest common prefix; a
scan over the array, chunk by chunk, keeps the open prefix intervals as a stack of (depth, first copy) and so gives
each suffix the longest run that begins at it and has an earlier copy. Lines in such runs of enough words are
deleted; the first copy of a run stays.

Texts are ordered by id, lines by number. Of suffixes that are equal to the end of their texts the first stands for
all; the others' runs are known at once and leave the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgelake.llm.words import WORD
from edgelake.operators.scale import lookup_join
from edgelake.session import scratch, stored

MIN_WORDS = 50
CHUNKS = 2000
CHUNK_SIZES = (1 << 12, 1 << 18)
PARTS = 512
END = -(1 << 63)
LAST_ID = (1 << 63) - 1
DEEP = 1 << 31

Place = tuple[int, int, int]
Stairs = list[tuple[int, Place]]


def line_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line ids and words per line of each text: d (id, the largest number for null), t (hash of the text), ids, words.

    One row per id and text; null and empty texts have none.
    """
    lines = F.col("lines")
    return (
        docs.select(
            F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("d"),
            F.xxhash64(F.col(text_col)).alias("t"),
            F.split(F.col(text_col), "\n").alias("lines"),
        )
        .where("size(lines) > 1 OR lines[0] <> ''")
        .select(
            "d", "t",
            F.transform(lines, lambda x: F.xxhash64(x)).alias("ids"),
            F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"),
        )
        .dropDuplicates(["d", "t"])
    )


def _ranked(groups: DataFrame, by: list[str], order: str, part: Column) -> DataFrame:
    """Rows of ``groups`` with ``before``, the sum of n over smaller ``order`` in the same ``by``.

    Rows are cut into parts by a column that grows with the order, so no class is sorted by one task.
    """
    parted = groups.withColumn("part", part)
    inside = Window.partitionBy(*by, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy(*by, "part").agg(F.sum("n").alias("n"))
    offsets = totals.select(*by, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    own = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return (
        parted.withColumn("own", own)
        .join(offsets, [*by, "part"])
        .withColumn("before", F.col("offset") + F.col("own"))
        .drop("part", "own", "offset")
    )


def _updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank arrays with the new ranks of some lines put in."""
    for batch in batches:
        rows = []
        for ranks, lines, new in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            own = np.array(ranks, np.int64)
            own[np.array(lines, np.int64)] = np.array(new, np.int64)
            rows.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], ["d", "t", "ranks"]
        )


RANKS = "d bigint, t bigint, ranks array<bigint>"


def _put(ranks: DataFrame, changed: DataFrame) -> DataFrame:
    """Rank arrays of the texts with changed lines (d, t, line, rank), with the changes."""
    per_text = changed.groupBy("d", "t").agg(F.collect_list(F.struct("line", "rank")).alias("c"))
    return (
        ranks.join(per_text, ["d", "t"])
        .select("d", "t", "ranks", F.col("c.line").alias("lines"), F.col("c.rank").alias("new"))
        .mapInArrow(_updated, RANKS)
    )


def suffix_array(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suffix array of repeated lines, and the runs of suffixes that equal an earlier one to the end.

    The array has d, t, line, rest (lines to the end of the text), before (id of the line before, null at the
    beginning), path (the ranks by 1, 2, 4, ... lines while shared) and rank, which orders it. Suffixes whose first
    line is nowhere else are left out. The runs have d, t, line, length.
    """
    lines = stored(seqs.select("d", "t", F.size("ids").alias("size"), F.posexplode("ids").alias("line", "id")), "lines")
    shared = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = F.shiftright("id", 54)
    classes = stored(_ranked(stored(shared, "shared").withColumn("all", F.lit(0)), ["all"], "id", top).select("id", F.col("before").alias("rank")), "classes")
    active = lookup_join(lines, classes, ["id"]).select("d", "t", "line", (F.col("size") - F.col("line")).alias("rest"), "rank")
    unique = F.transform("ids", lambda x: -F.shiftrightunsigned(x, 2) - 1)
    live = stored(active, "active")
    ranks = stored(_put(seqs.select("d", "t", unique.alias("ranks")), live), "ranks")
    before = seqs.select("d", "t", "ids")
    active = live.join(before, ["d", "t"]).select(
        "d", "t", "line", "rest", F.get("ids", F.col("line") - 1).alias("before"), F.array("rank").alias("path"), "rank"
    )
    active = stored(active, "active")
    total = max(1, lines.count())
    entries = ended = None
    length = 1
    while not active.isEmpty():
        follow = F.when(F.col("rest") <= length, F.lit(END)).otherwise(F.get("ranks", F.col("line") + length))
        pairs = stored(active.join(ranks, ["d", "t"]).withColumn("next", follow).drop("ranks"), "pairs")
        groups = stored(
            pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "line")).alias("first")),
            "groups",
        )
        part = F.when(F.col("next") < 0, F.shiftright("next", 54)).otherwise(F.floor(F.col("next") * PARTS / total))
        placed = _ranked(groups, ["rank"], "next", part).withColumn("new", F.col("rank") + F.col("before")).drop("before")
        known = pairs.join(placed, ["rank", "next"]).select(
            "d", "t", "line", "rest", "before", F.concat("path", F.array("new")).alias("path"), F.col("new").alias("rank"),
            (F.col("n") == 1).alias("alone"),
            (F.col("next") == END).alias("equal"),
            (F.col("first") == F.struct("d", "t", "line")).alias("is_first"),
        )
        known = stored(known, "known")
        shared_still = known.where("NOT alone AND NOT equal")
        done = known.where("alone OR (equal AND is_first)").select("d", "t", "line", "rest", "before", "path", "rank")
        same = known.where("NOT alone AND equal AND NOT is_first").select("d", "t", "line", F.col("rest").alias("length"))
        entries = done if entries is None else entries.unionAll(done)
        ended = same if ended is None else ended.unionAll(same)
        active = shared_still.select("d", "t", "line", "rest", "before", "path", "rank")
        texts = active.select("d", "t").distinct()
        ranks = stored(_put(ranks.join(texts, ["d", "t"], "left_semi"), known.select("d", "t", "line", "rank")), "ranks")
        length *= 2
    if entries is None:
        entries = active.select("d", "t", "line", "rest", "before", "path", "rank")
        ended = active.select("d", "t", "line", F.col("rest").alias("length"))
    return entries, ended


def common_prefixes(entries: DataFrame, seqs: DataFrame) -> DataFrame:
    """The array with lcp, the lines each suffix shares with the one before it: chunk, rank, d, t, line, lcp.

    Chunks are so many that they spread over the tasks, and small enough for one task each. Where two neighbours also share the line before them, the value follows from that of the suffixes one line
    earlier; only for the others lines are compared, at most twice as many as are shared.
    """
    entries = stored(entries, "array")
    least, most = CHUNK_SIZES
    size = min(max(entries.count() // CHUNKS, least), most)
    entries = entries.withColumn("chunk", F.floor(F.col("rank") / size))
    own = F.struct("rank", "d", "t", "line", F.col("before").alias("before"))
    lasts = entries.groupBy("chunk").agg(F.max(own).alias("last"))
    carried = lasts.select("chunk", F.lag("last").over(Window.orderBy("chunk")).alias("carried"))
    inside = F.lag(own).over(Window.partitionBy("chunk").orderBy("rank"))
    near = lookup_join(entries.withColumn("inside", inside), carried, ["chunk"]).withColumn("prev", F.coalesce("inside", "carried"))
    shared = F.size(F.filter("path", lambda v: v <= F.col("prev.rank")))
    level = F.when(F.col("prev").isNull(), 0).otherwise(shared)
    near = near.withColumn("level", level).withColumn(
        "follows", (F.col("level") > 0) & F.coalesce(F.col("before") == F.col("prev.before"), F.lit(False))
    )
    near = stored(near.select("chunk", "rank", "d", "t", "line", "level", "follows", "prev"), "near")
    asked = near.where("NOT follows AND level > 1").withColumn("from", F.pow(F.lit(2), F.col("level") - 1).cast("int"))

    def some(line: Column) -> Column:
        return F.slice("ids", (line + F.col("from") + 1).cast("int"), F.col("from") - 1)

    mine = asked.join(seqs.select("d", "t", "ids"), ["d", "t"]).select(
        "d", "t", "line", "from", F.col("prev.line").alias("pl"), F.col("prev.d").alias("pd"), F.col("prev.t").alias("pt"), some(F.col("line")).alias("a")
    )
    theirs = seqs.select(F.col("d").alias("pd"), F.col("t").alias("pt"), "ids")
    both = mine.join(theirs, ["pd", "pt"]).select("d", "t", "line", "from", "a", some(F.col("pl")).alias("b"))
    most = F.least(F.size("a"), F.size("b"))
    differ = F.array_position(F.transform(F.sequence(F.lit(0), most), lambda i: (i < most) & (F.get("a", i) == F.get("b", i))), False)
    compared = both.select("d", "t", "line", (F.col("from") + differ - 1).alias("compared"))
    known = near.join(stored(compared, "compared"), ["d", "t", "line"], "left")
    value = F.when(~F.col("follows"), F.col("line") + F.coalesce("compared", F.least("level", F.lit(1))))
    along = Window.partitionBy("d", "t").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lcp = F.greatest(F.last(value, ignorenulls=True).over(along) - F.col("line"), F.lit(0))
    return known.select("chunk", "rank", "d", "t", "line", lcp.cast("bigint").alias("lcp"))


def _scan(places: list[Place], depths: list[int], stack: Stairs) -> tuple[list[int], Stairs]:
    """For each suffix the most lines it shares with a suffix before it in the scan that begins earlier in the texts.

    ``depths`` are the shared lines with the suffix before. The stack holds open intervals: depth, and the first
    place in the interval; deeper ones have later places, or they would be of no use.
    """
    found = []
    for place, depth in zip(places, depths):
        least = None
        while stack and stack[-1][0] > depth:
            least = stack.pop()[1]
        if least is not None and depth > 0 and not (stack and stack[-1][0] == depth):
            stack.append((depth, least))
        while stack and stack[-1][1] > place:
            stack.pop()
        found.append(stack[-1][0] if stack else 0)
        stack.append((DEEP, place))
    return found, stack


def _joined(near: Stairs, far: Stairs, most: int) -> Stairs:
    """Open intervals behind a chunk: those that begin in it and those before it that reach through it."""
    kept: Stairs = []
    for depth, place in sorted([*near, *((min(d, most), p) for d, p in far)], key=lambda x: (-x[0], x[1])):
        if depth > 0 and (not kept or place < kept[-1][1]) and not (kept and kept[-1][0] == depth):
            kept.append((depth, place))
    return kept[::-1]


def _columns(table: pa.Table) -> tuple[list[Place], list[int]]:
    table = table.sort_by("rank")
    places = list(zip(*(table.column(c).to_pylist() for c in ("d", "t", "line"))))
    return places, table.column("lcp").to_pylist()


def _backwards(places: list[Place], depths: list[int], stack: Stairs) -> tuple[list[int], Stairs]:
    found, stack = _scan(places[::-1], [DEEP, *depths[:0:-1]], stack)
    return found[::-1], stack


STEP = pa.struct([("depth", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("line", pa.int64())])
STAIRS = "array<struct<depth:bigint,d:bigint,t:bigint,line:bigint>>"
FAN = 64


def _steps(stacks: list[Stairs]) -> pa.Array:
    rows = [[{"depth": d, "d": p[0], "t": p[1], "line": p[2]} for d, p in stack] for stack in stacks]
    return pa.array(rows, pa.list_(STEP))


def _stacks(column: pa.ChunkedArray) -> list[Stairs]:
    return [[(x["depth"], (x["d"], x["t"], x["line"])) for x in row] for row in column.to_pylist()]


def _nodes(table: pa.Table) -> list[tuple[int, int, Stairs, Stairs]]:
    """Neighbours in order: node, the least shared lines in it, what reaches out of it to the left and to the right."""
    table = table.sort_by("node")
    ahead, behind = _stacks(table.column("ahead")), _stacks(table.column("behind"))
    return list(zip(table.column("node").to_pylist(), table.column("least").to_pylist(), ahead, behind))


def _merged(table: pa.Table) -> pa.Table:
    """Neighbours as one node of the next level."""
    nodes = _nodes(table)
    behind: Stairs = []
    ahead: Stairs = []
    for _, least, _, own in nodes:
        behind = _joined(own, behind, least)
    for _, least, own, _ in reversed(nodes):
        ahead = _joined(own, ahead, least)
    return pa.table({
        "node": table.column("parent").slice(0, 1),
        "least": pa.array([min(n[1] for n in nodes)], pa.int64()),
        "ahead": _steps([ahead]),
        "behind": _steps([behind]),
    })


def _handed_down(table: pa.Table, parent: pa.Table) -> pa.Table:
    """What reaches into each of some neighbours from the left and from the right."""
    nodes = _nodes(table)
    carry = _stacks(parent.column("left"))[0] if parent.num_rows else []
    left, right = [], []
    for _, least, _, own in nodes:
        left.append(carry)
        carry = _joined(own, carry, least)
    carry = _stacks(parent.column("right"))[0] if parent.num_rows else []
    for _, least, own, _ in reversed(nodes):
        right.append(carry)
        carry = _joined(own, carry, least)
    return pa.table({"node": pa.array([n[0] for n in nodes], pa.int64()), "left": _steps(left), "right": _steps(right[::-1])})


def _open_intervals(chunks: DataFrame) -> DataFrame:
    """What reaches into each chunk from its left and its right: node, left, right.

    Joining open intervals is associative, so they are summed up a tree over the chunks, ``FAN`` to a node, and handed
    down again. A task holds the intervals of one node's children; the driver holds the number of the last chunk.
    """
    levels = [chunks]
    last = chunks.agg(F.max("node")).first()[0] or 0
    parent = F.floor(F.col("node") / FAN)
    while last >= FAN:
        up = levels[-1].withColumn("parent", parent).groupBy("parent").applyInArrow(_merged, f"node bigint, least bigint, ahead {STAIRS}, behind {STAIRS}")
        levels.append(stored(up, "intervals"))
        last //= FAN
    reach = chunks.sparkSession.createDataFrame([], f"node bigint, left {STAIRS}, right {STAIRS}")
    for level in reversed(levels):
        children = level.withColumn("parent", parent).groupBy("parent")
        down = children.cogroup(reach.withColumn("parent", F.col("node")).groupBy("parent"))
        reach = stored(down.applyInArrow(_handed_down, f"node bigint, left {STAIRS}, right {STAIRS}"), "reach")
    return reach


def previous_runs(array: DataFrame) -> DataFrame:
    """Runs with an earlier copy: d, t, line, length (the longest such run that begins at the line).

    Every chunk is scanned from both sides by one task; what reaches over its borders are a few open intervals, one
    per depth, which a tree over the chunks sums up and hands to each chunk before the second scan.
    """
    array = stored(array, "prefixes")

    def summary(table: pa.Table) -> pa.Table:
        places, depths = _columns(table)
        _, right = _scan(places, [DEEP, *depths[1:]], [])
        _, left = _backwards(places, depths, [])
        return pa.table({
            "node": table.column("chunk").slice(0, 1),
            "least": pa.array([min(depths)], pa.int64()),
            "ahead": _steps([_joined([], left, depths[0])]),
            "behind": _steps([right]),
        })

    chunks = array.groupBy("chunk").applyInArrow(summary, f"node bigint, least bigint, ahead {STAIRS}, behind {STAIRS}")
    reach = _open_intervals(stored(chunks, "summaries"))

    def runs(table: pa.Table, reach: pa.Table) -> pa.Table:
        places, depths = _columns(table)
        left, _ = _scan(places, depths, _stacks(reach.column("left"))[0])
        right, _ = _backwards(places, depths, _stacks(reach.column("right"))[0])
        length = np.minimum(np.maximum(left, right), DEEP - 1)
        rows = np.flatnonzero(length > 0)
        d, t, line = (np.array([places[i][c] for i in rows], np.int64) for c in range(3))
        return pa.table({"d": d, "t": t, "line": line.astype(np.int32), "length": length[rows].astype(np.int64)})

    both = array.groupBy("chunk").cogroup(reach.withColumnRenamed("node", "chunk").groupBy("chunk"))
    return both.applyInArrow(runs, "d bigint, t bigint, line int, length bigint")


def _kept_lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for words, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sums = np.concatenate([[0], np.cumsum(words)])
                change = np.zeros(len(words) + 1, np.int64)
                for x in runs:
                    begin, end = x["line"], x["line"] + x["length"]
                    if sums[end] - sums[begin] >= min_words:
                        change[begin] += 1
                        change[end] -= 1
                keep.append(np.cumsum(change[:-1]) == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.list_(pa.bool_()))], ["d", "t", "keep"])

    return run


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Texts with lines to delete: d, t and keep, which says for each line whether it stays.

    A line goes if it lies in a run of lines, of at least ``min_words`` words together, that also begins at an earlier
    place: in a text of a smaller id, or further up in the same text.
    """
    with scratch(docs.sparkSession) as outlive:
        seqs = stored(line_sequences(docs, id_col, text_col), "sequences")
        entries, ended = suffix_array(seqs)
        runs = previous_runs(common_prefixes(entries, seqs)).unionByName(ended.withColumn("length", F.col("length").cast("bigint")))
        per_text = runs.groupBy("d", "t").agg(F.collect_list(F.struct("line", "length")).alias("runs"))
        marked = seqs.join(per_text, ["d", "t"]).select("d", "t", "words", "runs")
        kept = marked.mapInArrow(_kept_lines(min_words), "d bigint, t bigint, keep array<boolean>")
        return outlive(kept.where(F.exists("keep", lambda x: ~x)), "copies")


def _judged(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Rows as ``_row`` with ``_text`` (rewritten), ``_lines`` and ``_deleted``; the user's columns stay inside the struct."""
    copies = later_copies(docs, id_col, text_col, min_words).select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("keep").alias("_keep"))
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("_d"),
        F.xxhash64(F.col(text_col)).alias("_t"),
    )
    joined = lookup_join(rows, copies, ["_d", "_t"], "left")
    text, changed = F.col("_row")[text_col], F.col("_keep").isNotNull()
    lines = F.split(text, "\n")
    shorter = F.array_join(F.filter(lines, lambda x, i: F.get("_keep", i)), "\n")
    deleted = F.size(F.filter("_keep", lambda x: ~x))
    return joined.select(
        "_row",
        F.when(changed, shorter).otherwise(text).alias("_text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("_lines"),
        F.when(changed, deleted).otherwise(0).cast("bigint").alias("_deleted"),
    )


def delete_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
    lines_col: str = "_lines", deleted_col: str = "_deleted",
) -> DataFrame:
    """``docs`` without the lines that are later copies of runs: text is rewritten, all columns stay.

    Adds the numbers of lines before and deleted, under names that must not be columns of ``docs``. Rows of one id with one text
    are one document and judged alike; null ids come after all others; null and empty texts stay as they are; no rows
    give no rows. A text of any length is one row of its lines' ids.
    """
    if taken := {lines_col, deleted_col} & set(docs.columns):
        raise ValueError(f"docs have a column {taken}; name the added columns by lines_col and deleted_col")
    return _judged(docs, id_col, text_col, min_words).select(
        *[F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns],
        F.col("_lines").alias(lines_col),
        F.col("_deleted").alias(deleted_col),
    )


def without_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` without later copies of runs, and without the rows of which nothing else is left.

    All columns stay; ``size_col``, where there is one, follows the shorter text.
    """
    found = _judged(docs, id_col, text_col, min_words).where("_deleted = 0 OR _deleted < _lines")

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("_text")
        if c == size_col:
            return F.when(F.col("_deleted") > 0, F.length("_text")).otherwise(F.col("_row")[c]).cast(docs.schema[c].dataType)
        return F.col("_row")[c]

    return found.select(*[column(c).alias(c) for c in docs.columns])

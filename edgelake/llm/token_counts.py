"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens: leaves are runs of pre-tokens with their characters and tokens,
and every node above holds the sums of its children. An edit finds its leaves by descending the sums, re-encodes
text from the leaf of the edit's left neighbour until the pre-tokens fall in step with an old leaf again, and updates the
sums above what changed.

Pre-tokens are found from left to right and each depends only on the text from its beginning to one character past
its end. So what ends two characters or more before an edit stays, and from a place where old and new pre-tokens both
begin behind the edit everything stays.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.llm.words import slices
from edgelake.operators.scale import lookup_join
from edgelake.session import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
FAN = 16
CACHE = 1 << 19
EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
REDACTED = "<EMAIL>"
TREE = "leaf_chars array<int>, leaf_tokens array<int>"


class Counter(dict):
    """Tokens of pre-tokens by byte-pair encoding; keeps what it has seen, up to a bound."""

    def __init__(self, vocabulary: str = VOCABULARY):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.scan = regex.compile(PATTERN).finditer

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = len(self.encoding._core_bpe.encode_single_piece(piece.encode("utf-8", "replace")))
        self[piece] = n
        return n


_counters: dict[str, Counter] = {}


def counter(vocabulary: str = VOCABULARY) -> Counter:
    """The counter of a vocabulary, one per worker."""
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


def leaves(text: str, count: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each run of LEAF pre-tokens."""
    pieces = count.split(text)
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.arange(0, len(pieces), LEAF)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    tokens = np.fromiter(map(count.__getitem__, pieces), np.int64, len(pieces))
    return np.add.reduceat(sizes, cuts), np.add.reduceat(tokens, cuts)


class SegmentTree:
    """Sums of characters and tokens over leaves; level 0 has the leaves, each level above sums FAN nodes."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.levels = [np.stack([chars, tokens])]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.add.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    @property
    def chars(self) -> int:
        return int(self.levels[-1][0].sum())

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][1].sum())

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last leaf for one past the end), and where the leaf begins."""
        node, begin = 0, 0
        for depth in range(len(self.levels) - 1, -1, -1):
            row = self.levels[depth][0]
            if depth < len(self.levels) - 1:
                node *= FAN
            last = min(node + FAN, len(row)) - 1
            while node < last and begin + row[node] <= char:
                begin += int(row[node])
                node += 1
        return node, begin

    def replace(self, low: int, high: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Put new leaves in the place of leaves low to high - 1 and update the sums above them.

        With as many leaves as before only the nodes above them change; otherwise all to the right shift too.
        """
        new = np.stack([chars, tokens])
        same = new.shape[1] == high - low
        if same:
            self.levels[0][:, low:high] = new
        else:
            self.levels[0] = np.concatenate([self.levels[0][:, :low], new, self.levels[0][:, high:]], axis=1)
        first, stop = low, high if same else self.levels[0].shape[1]
        depth = 0
        while self.levels[depth].shape[1] > 1:
            below = self.levels[depth]
            first, stop = first // FAN, -(-max(stop, first + 1) // FAN)
            width = -(-below.shape[1] // FAN)
            begins = np.arange(first * FAN, min(stop * FAN, below.shape[1]), FAN)
            part = np.add.reduceat(below[:, : stop * FAN], begins, axis=1) if len(begins) else below[:, :0]
            if depth + 1 == len(self.levels):
                self.levels.append(np.zeros((2, 0), np.int64))
            above = self.levels[depth + 1]
            if same:
                above[:, first : first + part.shape[1]] = part
            else:
                self.levels[depth + 1] = np.concatenate([above[:, :first], part], axis=1)[:, :width]
            depth += 1
        del self.levels[depth + 1 :]


def apply_edits(text: str, tree: SegmentTree, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, int]:
    """Apply edits (start, end, replacement) to a text and its tree; returns the new text and the pre-tokens re-encoded.

    Edits are places in the text as it was, and do not overlap; they are applied from the last to the first, so each
    finds the places before it unchanged.
    """
    again = 0
    for start, end, new in sorted(edits, reverse=True):
        if not 0 <= start <= end <= len(text):
            raise ValueError(f"edit {start}:{end} is outside a text of {len(text)} characters")
        text = text[:start] + new + text[end:]
        if not tree.levels[0].shape[1]:
            chars, tokens = leaves(text, count)
            tree.levels = SegmentTree(chars, tokens).levels
            again += len(count.split(text))
            continue
        low, begin = tree.find(max(start - 2, 0))
        shift = len(new) - (end - start)
        high, old_end = tree.find(end)
        old_end += int(tree.levels[0][0, high])
        high += 1
        sizes: list[int] = []
        tokens: list[int] = []
        for match in count.scan(text, begin):
            sizes.append(match.end() - match.start())
            tokens.append(count[match[0]])
            while high < tree.levels[0].shape[1] and old_end + shift < match.end():
                old_end += int(tree.levels[0][0, high])
                high += 1
            if match.end() == old_end + shift and match.end() >= start + len(new):
                break
        again += len(sizes)
        cuts = np.arange(0, len(sizes), LEAF)
        parts = [np.add.reduceat(np.array(x, np.int64), cuts) if sizes else np.zeros(0, np.int64) for x in (sizes, tokens)]
        tree.replace(low, high, *parts)
    return text, again


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The leaves of every row's tree: doc_id, text_key (a hash of the text), n_pretokens, n_tokens, leaf_chars, leaf_tokens.

    The levels above are sums that a reader makes from the leaves. A null text is an empty one, with no leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                found = [leaves(t or "", count) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1),
                        pa.array([int(t.sum()) for _, t in found], pa.int64()),
                        pa.array([c.astype(np.int32) for c, _ in found], pa.list_(pa.int32())),
                        pa.array([t.astype(np.int32) for _, t in found], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "text_key", "n_tokens", "leaf_chars", "leaf_tokens"],
                )

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, text_key bigint, n_tokens bigint, {TREE}")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text")
    )


def email_redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edits that redact e-mail addresses: doc_id, text_key, edits (start, stop, replacement); rows with edits only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("replacement", pa.string())]))
        for batch in batches:
            edits = [
                [{"start": m.start(), "stop": m.end(), "replacement": REDACTED} for m in EMAIL.finditer(t)]
                for t in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edits, kind)], ["doc_id", "text_key", "edits"])

    marked = _keyed(docs, id_col, text_col).where(F.col("text").contains("@"))
    found = marked.mapInArrow(run, "doc_id bigint, text_key bigint, edits array<struct<start:int,stop:int,replacement:string>>")
    return found.where(F.size("edits") > 0).dropDuplicates(["doc_id", "text_key"])


def recount(
    docs: DataFrame, trees: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Token counts after edits: doc_id, n_tokens (before), n_edits, n_tokens_after, n_reencoded (pre-tokens), text_after
    and the new leaves of rows with edits.

    ``trees`` is the stored result of ``build_trees`` on the same rows, ``edits`` has doc_id, text_key and edits, once per
    text. Only texts with edits are read again; others keep their counts. Repeated rows are edited alike.
    """
    key = F.xxhash64("doc_id", "text_key").alias("_key")
    keyed = edits.select(key, "edits")
    texts = lookup_join(_keyed(docs, id_col, text_col).select("text", key), keyed, ["_key"]).dropDuplicates(["_key"])
    touched = lookup_join(trees.select("*", key), keyed.select("_key"), ["_key"], "left_semi").dropDuplicates(["_key"])
    work = texts.join(touched.select("_key", "n_tokens", "leaf_chars", "leaf_tokens"), "_key").select(
        "_key", "text", "edits", "leaf_chars", "leaf_tokens"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                rows: dict[str, list] = {k: [] for k in ("n_edits", "after", "again", "text", "chars", "tokens")}
                part = batch.slice(low, high - low)
                for row in part.to_pylist():
                    tree = SegmentTree(np.array(row["leaf_chars"], np.int64), np.array(row["leaf_tokens"], np.int64))
                    changes = [(e["start"], e["stop"], e["replacement"]) for e in row["edits"]]
                    text, again = apply_edits(row["text"], tree, changes, count)
                    for k, value in zip(rows, (len(changes), tree.tokens, again, text, tree.levels[0][0], tree.levels[0][1])):
                        rows[k].append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(x, k) for x, k in zip(rows.values(), kinds)]],
                    ["_key", "n_edits", "n_tokens_after", "n_reencoded", "text_after", "leaf_chars_after", "leaf_tokens_after"],
                )

    changed = stored(
        work.mapInArrow(
            run,
            "_key bigint, n_edits bigint, n_tokens_after bigint, n_reencoded bigint, text_after string, "
            "leaf_chars_after array<int>, leaf_tokens_after array<int>",
        ),
        "recounted",
    )
    none = F.lit(0).cast("bigint")
    return lookup_join(trees.select("doc_id", "n_tokens", key), changed, ["_key"], "left").select(
        "doc_id",
        "n_tokens",
        F.coalesce("n_edits", none).alias("n_edits"),
        F.coalesce("n_tokens_after", "n_tokens").alias("n_tokens_after"),
        F.coalesce("n_reencoded", none).alias("n_reencoded"),
        "text_after", "leaf_chars_after", "leaf_tokens_after",
    )


def redacted_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of every row before and after its e-mail addresses are redacted; columns as ``recount``."""
    trees = stored(build_trees(docs, id_col, text_col, vocabulary), "trees")
    edits = stored(email_redactions(docs, id_col, text_col), "edits")
    return recount(docs, trees, edits, id_col, text_col, vocabulary)

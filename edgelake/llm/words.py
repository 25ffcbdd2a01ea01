"""Words of texts: as Spark columns, and as flat numpy arrays over the Arrow buffers of a batch.

A word is a longest run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SLICE_BYTES = 2 << 20
SHORT_SLICE_BYTES = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_list(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, also where ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed, one to one."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes of text each; a longer text is a range of its own."""
    sizes = np.diff(_offsets(texts))
    first = total = 0
    for row, size in enumerate(sizes.tolist()):
        if row > first and total + size > most:
            yield first, row
            first, total = row, 0
        total += size
    if len(sizes) > first:
        yield first, len(sizes)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, kind)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]


@dataclass
class Words:
    """Words of a run of texts: ``data`` has the bytes of all texts, ``at`` where each text begins in it
    (and the end), ``starts`` and ``ends`` each word's bytes, ``doc`` the text each word is in."""

    data: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """For each text the number of its first word, and the number of all words at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.at)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        powers = np.full(int(sizes.max()), _STEP | np.uint64(1), np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        values = mixed(np.arange(256, dtype=np.uint64))[self.data[np.repeat(self.starts, sizes) + inside]]
        return mixed(np.add.reduceat(values * powers[inside], ends - sizes) + sizes.astype(np.uint64))


def words_of(texts: pa.Array, lower: bool = False, of: np.ndarray | None = None) -> Words:
    """Words of an Arrow array of strings; a null is an empty text. ``lower`` folds A-Z only.

    ``of`` tells for each of the 256 bytes whether it belongs to words, where that is not all but blanks.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    at = _offsets(texts).astype(np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13))) if of is None else of[data]
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = ~inside[:-1]
    begins[at] = True
    starts = np.flatnonzero(inside & begins[:-1])
    breaks = np.ones(len(data) + 1, bool)
    breaks[:-1] = ~inside
    breaks[at] = True
    ends = np.flatnonzero(inside & breaks[1:]) + 1
    doc = np.searchsorted(at, starts, side="right") - 1
    return Words(data, at, starts, ends, doc)


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words inside one text, and the text of each.

    ``first`` has the first word of each text and the number of all words; a text with at least one but
    fewer than ``width`` words has none.
    """
    counts = np.maximum(np.diff(first) - width + 1, 0)
    ends = np.cumsum(counts)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    return first[:-1][doc] + inside, doc


def window_hashes(words: np.ndarray, starts: np.ndarray, offsets: list[int] | range) -> np.ndarray:
    """A 64-bit hash of the words at ``offsets`` from each start."""
    total = np.zeros(len(starts), np.uint64)
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        for offset in offsets:
            total += words[starts + offset] * weight
            weight = weight * _STEP | np.uint64(1)
    return mixed(total)

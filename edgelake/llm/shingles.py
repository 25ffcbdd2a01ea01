"""Sets of word shingles of texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from edgelake.llm.words import mixed, window_hashes, windows, words_of

SHINGLE_WORDS = 5


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, A-Z folded.

    A text with fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    words = words_of(texts, lower=True)
    hashes, first = words.hashes(), words.first
    starts, doc = windows(first, width)
    found = window_hashes(hashes, starts, range(width))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    sets = []
    for row in range(len(texts)):
        low, high = first[row], first[row + 1]
        if 0 < high - low < width:
            whole = window_hashes(hashes, first[row : row + 1], range(high - low))
            sets.append(mixed(whole + np.uint64(high - low)))
        else:
            sets.append(np.unique(found[bounds[row] : bounds[row + 1]]))
    return sets

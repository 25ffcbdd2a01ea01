import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from edgelake.llm.folds import fold
from edgelake.llm.shingles import shingle_sets
from edgelake.llm.words import slices, window_hashes, windows, word_count, word_list, words_of

TEXTS = ["one two", None, "", "  \t ", "É a\x0bB c\nd ", "x", "long" * 50, " a b"]


def test_flat_words_are_the_words_of_each_text():
    found = words_of(pa.array(TEXTS), lower=True)
    got = [[] for _ in TEXTS]
    for begin, end, doc in zip(found.starts, found.ends, found.doc):
        got[doc].append(bytes(found.data[begin:end]).decode())
    fold_case = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", fold_case(t)) for t in TEXTS]
    assert found.first.tolist() == np.cumsum([0, *map(len, got)]).tolist()


def test_word_hashes_depend_on_the_word_alone():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    texts = pa.array([" ".join(words[:200]), " ".join(words[200:])])
    hashes = words_of(texts).hashes()
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    sliced = words_of(pa.array(["skipped", *texts.to_pylist()]).slice(1)).hashes()
    assert (sliced == hashes).all()


def test_windows_stay_inside_a_text():
    words = words_of(pa.array(["a b c", "a b", "", "a b c d"]))
    starts, doc = windows(words.first, 3)
    assert starts.tolist() == [0, 5, 6] and doc.tolist() == [0, 3, 3]
    hashes = window_hashes(words.hashes(), starts, range(3))
    assert hashes[0] == hashes[1] != hashes[2]


def test_slices_cover_all_rows_and_long_texts_stand_alone():
    texts = pa.array(["a" * 5, None, "b" * 50, "c", "", "d"])
    assert list(slices(texts, 10)) == [(0, 2), (2, 3), (3, 6)]
    assert list(slices(pa.array([], pa.string()))) == []


def test_shingle_sets():
    sets = shingle_sets(pa.array(["A b c d e f", "a b c d e a b c d e", "a b", "A B", None, "b a", "a b c d e"]))
    assert [len(s) for s in sets] == [2, 5, 1, 1, 0, 1, 1]
    assert sets[2].tolist() == sets[3].tolist() != sets[5].tolist()
    assert sets[6][0] in sets[0] and sets[6][0] in sets[1]


def test_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", word_count(F.col("t")).alias("n"), word_list(F.col("t")).alias("w")).collect()
    for r in rows:
        want = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.i] or "")
        assert (r.n, r.w) == (len(want), want)


def test_fold(spark):
    import zlib

    got = spark.createDataFrame([(7,), (None,), (-12,)], "i long").select("i", fold(F.col("i"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str("" if r.i is None else r.i).encode()) % 4 for r in got)

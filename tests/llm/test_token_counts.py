import random

import pytest

from edgelake.llm import token_counts as tc

ALPHABET = "ab c  \n\t'sdm 12.é,!  xyz　ß"


@pytest.fixture(scope="module")
def count():
    return tc.counter()


@pytest.mark.parametrize("seed", range(4))
def test_edited_trees_equal_new_ones(count, seed):
    rng = random.Random(seed)
    text_of = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    for _ in range(200):
        text = text_of(rng.choice([0, 3, 30, 300, 3000]))
        tree = tc.SegmentTree(*tc.leaves(text, count))
        assert tree.tokens == len(count.encoding.encode_ordinary(text))
        points = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4))))
        edits = [(a, b, text_of(rng.choice([0, 1, 5, 200]))) for a, b in zip(points[::2], points[1::2])]
        want = text
        for a, b, new in sorted(edits, reverse=True):
            want = want[:a] + new + want[b:]
        got, _ = tc.apply_edits(text, tree, edits, count)
        assert got == want and tree.chars == len(want) and tree.tokens == len(count.encoding.encode_ordinary(want))
        fresh = tc.SegmentTree(*tree.levels[0])
        assert len(fresh.levels) == len(tree.levels)
        assert all((a == b).all() for a, b in zip(fresh.levels, tree.levels))


def test_small_edits_re_encode_little(count):
    text = "The quick brown fox jumps over the lazy dog. " * 5000
    tree = tc.SegmentTree(*tc.leaves(text, count))
    _, again = tc.apply_edits(text, tree, [(100_000, 100_005, "cat")], count)
    assert again <= 4 * tc.LEAF


def test_edits_outside_the_text_are_refused(count):
    with pytest.raises(ValueError):
        tc.apply_edits("abc", tc.SegmentTree(*tc.leaves("abc", count)), [(2, 9, "")], count)


def test_rows(documents, count):
    rows = [(1, "mail me@example.com or you@mail.example.org now"), (2, "no address @ all"), (3, None), (4, ""), (None, "x me@example.com"),
            (1, "another text of one id, b@c.de"), (5, "é" * 10 + " a@b.co"), (5, "é" * 10 + " a@b.co")]
    got = tc.redacted_counts(documents(rows)).collect()
    assert len(got) == len(rows)
    tokens = lambda t: len(count.encoding.encode_ordinary(t or ""))
    want = sorted((i or 0, tokens(t), len(tc.EMAIL.findall(t or "")), tokens(tc.EMAIL.sub(tc.REDACTED, t or ""))) for i, t in rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_edits, r.n_tokens_after) for r in got) == want
    assert tc.redacted_counts(documents(rows).where("false")).count() == 0


def test_registered_query_equals_a_full_count(spark, sf, count):
    from edgelake.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op9_token_recount"](spark, sf).collect():
        after = tc.EMAIL.sub(tc.REDACTED, texts[r.doc_id])
        assert r.n_tokens == len(count.encoding.encode_ordinary(texts[r.doc_id]))
        assert r.n_tokens_after == len(count.encoding.encode_ordinary(after))

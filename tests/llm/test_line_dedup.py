import random

import pytest

from edgelake.llm import line_dedup


def brute(docs, min_words):
    docs = sorted({d for d in docs if d[1]}, key=lambda x: (x[0] is None, x[0] or 0))
    lines = [t.split("\n") for _, t in docs]
    places = [(i, j) for i, own in enumerate(lines) for j in range(len(own))]
    gone = [[False] * len(own) for own in lines]
    for n, (i, j) in enumerate(places):
        best = 0
        for a, b in places[:n]:
            size = 0
            while j + size < len(lines[i]) and b + size < len(lines[a]) and lines[i][j + size] == lines[a][b + size]:
                size += 1
            best = max(best, size)
        if best and sum(len(x.split()) for x in lines[i][j : j + best]) >= min_words:
            gone[i][j : j + best] = [True] * best
    return {d: ("\n".join(x for x, g in zip(own, mark) if not g), sum(mark)) for (d, _), own, mark in zip(docs, lines, gone)}


@pytest.mark.parametrize("seed,fan", [(0, 64), (1, 2)])
def test_deleted_lines_equal_brute_force(documents, monkeypatch, seed, fan):
    monkeypatch.setattr(line_dedup, "CHUNK_SIZES", (7, 7))
    monkeypatch.setattr(line_dedup, "FAN", fan)
    rng = random.Random(seed)
    words = ["a", "b b", "c c c", "d", "e e", "", "  "]
    blocks = [[rng.choice(words) for _ in range(rng.randint(2, 9))] for _ in range(5)]
    docs = []
    for i in range(25):
        own = []
        for _ in range(rng.randint(0, 4)):
            own += rng.choice(blocks) if rng.random() < 0.6 else [rng.choice(words) + (str(rng.randint(0, 9)) if rng.random() < 0.4 else "")]
        docs.append((i, "\n".join(own)))
    docs += [(30, None), (31, docs[3][1]), (31, docs[3][1]), (None, docs[4][1]), (-5, docs[5][1])]
    found = line_dedup.delete_copies(documents(docs), min_words=4)
    assert found.columns[:-2] == documents(docs).columns
    rows, want = found.collect(), brute(docs, 4)
    assert len(rows) == len(docs)
    for r in rows:
        own = next(t for d, t in docs if d == r.doc_id)
        assert (r.text, r._deleted) == (want[r.doc_id] if own else (own, 0))


def test_passages_go_and_short_lines_stay(documents):
    passage = " ".join(f"p{i}" for i in range(30)) + "\n" + " ".join(f"q{i}" for i in range(25))
    short = "just a short common line"
    docs = [(i, f"{short}\nown {i}\n{passage}\ntail {i}") for i in range(40)] + [(90, passage), (91, short)]
    got = {r.doc_id: r for r in line_dedup.without_copies(documents(docs)).collect()}
    assert got[0].text == docs[0][1] and 90 not in got and got[91].text == short
    assert all(got[i].text == f"{short}\nown {i}\ntail {i}" and got[i].n_chars == len(got[i].text) for i in range(1, 40))


def test_long_repeats_in_one_text(documents):
    text = "\n".join(["w " * 60] * 300)
    got = line_dedup.delete_copies(documents([(1, text), (2, "x\ny")])).collect()
    assert {r.doc_id: r._deleted for r in got} == {1: 299, 2: 0}


def test_no_rows(documents):
    assert line_dedup.delete_copies(documents([(1, "a")]).where("false")).count() == 0
    assert line_dedup.delete_copies(documents([(1, None), (2, "")])).count() == 2


def test_names_of_added_columns(spark, documents):
    docs = spark.createDataFrame([(1, "a b\nc", "mine")], "doc_id long, text string, _deleted string")
    with pytest.raises(ValueError, match="_deleted"):
        line_dedup.delete_copies(docs)
    got = line_dedup.delete_copies(docs, deleted_col="gone").first()
    assert (got["_deleted"], got["gone"], got["_lines"]) == ("mine", 0, 2)

import random
import re

import pytest

from edgelake.llm import near_dup
from edgelake.llm.components import connected_components


def brute(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {(i, len(s)): find(i) for i, s in sets}


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("small", [2, 1000])
def test_groups_equal_brute_force(documents, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", small)
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 150, 400]))]
        for _ in range(rng.randint(1, 9)):
            base = changed(rng, base, rng.choice([0, 1, 1, 2, 4])) if rng.random() < 0.5 else base
            rows.append((len(rows) * 3 + 1, " ".join(changed(rng, base, rng.choice([0, 0, 1, 3])))))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A B"), (1005, "b a"), (1006, rows[0][1].upper())]
    rng.shuffle(rows)
    found = near_dup.near_duplicates(documents(rows)).collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in found} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_a_large_group_of_chained_copies_is_one(documents):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, rng.randint(0, 8)))) for i in range(150)] + [(900 + i, " ".join(base)) for i in range(50)]
    found = near_dup.near_duplicates(documents(rows)).collect()
    assert {(r.doc_id, r.n_shingles): r.component_id for r in found} == brute(rows)


def test_repeated_ids_are_one_document(documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (5, a), (5, b), (7, b), (None, a), (None, None), (3, a), (3, a)]
    found = near_dup.near_duplicates(documents(rows)).collect()
    assert {r.component_id for r in found if r.doc_id is not None} == {1}
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    kept = near_dup.keep_one(documents([(9, b), (9, b), (2, a), *rows[4:6]])).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 2, 9]


def test_no_rows(documents):
    empty = documents([(1, "a")]).where("false")
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def test_odd_sketches_estimate_similarity(documents):
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:360] + [f"x{i}" for i in range(40)]))]
    s = near_dup.sketches(documents(rows))
    a, b = s.where("doc_id = 1").select(F.col("odd").alias("a")), s.where("doc_id = 2").select(F.col("odd").alias("b"))
    got = a.join(b).select(near_dup.odd_similarity(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - 356 / 436) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (201, 200), (5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_a_pair_at_the_limit_whose_sketches_differ_by_chance_is_linked(documents):
    """Similarity 18 of 24; the odd sketches show 0.546."""
    numbers = """386709053 962474054 921382793 31413250 180738269 622267332 390790120 548753399 299226157 461376875 930860143
    651565433 60747107 329892500 463599922 663022917 499710814 617064874 156332457 284144694 702383162 499191620 585308723
    545407172 441090500"""
    text = " ".join(f"w{n}" for n in numbers.split())
    rows = [(1, text), (2, text.replace("w585308723", "w59113989"))]
    assert brute(rows) == {(1, 21): 1, (2, 21): 1}
    found = near_dup.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1}


@pytest.mark.parametrize("short", [near_dup.SHORT, 8])
def test_a_large_group_of_near_copies_equals_brute_force(spark, documents, short, monkeypatch):
    """Copies of one text with some words changed, many of them below the limit to the origin and linked over others only."""
    monkeypatch.setattr(near_dup, "SHORT", short)
    rng = random.Random(11)
    origin = [f"w{rng.randrange(40)}" for _ in range(90)]
    edits = [(rng.randrange(90), f"x{k}") for k in range(12)]
    texts = []
    for _ in range(260):
        words = list(origin)
        for at, new in rng.sample(edits, rng.choice([0, 1, 1, 2, 2, 3])):
            words[at] = new
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(90)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(words[: rng.choice([90, 90, 90, 80, 70])]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    least = list(range(len(texts)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                least[b] = a
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(documents(list(enumerate(texts)))).collect()}
    want = {i: top(i) for i in range(len(texts))}
    assert len(set(want.values())) > 10 and max(list(want.values()).count(c) for c in set(want.values())) > 50
    assert got == want


def test_intermediate_tables_and_shuffles_go(spark, documents):
    """What a search stored on its way is gone when its rows are read, and so are its shuffle files."""
    import os
    from pathlib import Path

    from edgelake.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = documents([(i, " ".join(changed(rng, base, rng.randint(0, 6)))) for i in range(120)])
    tables, shuffles = set(os.listdir(folder)), set(local.rglob("shuffle_*.data"))
    kept = near_dup.keep_one(docs)
    assert len(set(os.listdir(folder)) - tables) <= 3
    assert len(set(local.rglob("shuffle_*.data")) - shuffles) <= 8
    found = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in kept.collect()} == set(found.values())


def test_private_shingles_are_counted_from_lists(documents, monkeypatch):
    """Members of a large bucket that share one passage only are told by their private shingles, over several parts and slices."""
    monkeypatch.setattr(near_dup, "PART_SHINGLES", 50)
    passage = " ".join(f"p{i}" for i in range(20))
    docs = documents([(i, passage + " " + " ".join(f"d{i // 2}w{j}" for j in range(30 + i % 2))) for i in range(80)] + [(500, passage)])
    nodes = near_dup.sketches(docs).withColumnRenamed("doc_id", "node")
    members = nodes.selectExpr("1L AS key", "node", "81L AS n")
    asked = near_dup._not_alone(members, nodes, near_dup._texts(docs, "doc_id", "text"), 10)
    got = {r.node: r.private for r in asked.collect()}
    want = {i: i % 2 for i in range(80)} | {500: 0}
    assert got == want

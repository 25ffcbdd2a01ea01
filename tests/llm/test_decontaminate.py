import itertools
import random
import re

from edgelake.llm import decontaminate as dec


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def overlapped(text, item):
    a, b = words(text), words(item)
    if not b:
        return False
    width = min(dec.WINDOW, len(b))
    most = dec.SUBSTITUTIONS if len(b) >= dec.WINDOW else dec.SHORT_SUBSTITUTIONS if len(b) > dec.SOLID_ITEM else 0
    return any(
        sum(x != y for x, y in zip(a[i : i + width], b[j : j + width])) <= most
        for i in range(len(a) - width + 1) for j in range(len(b) - width + 1)
    )


def test_masks_miss_no_window_with_two_substitutions():
    kept = [[i for i, c in enumerate(m) if c == "1"] for m in dec.MASKS]
    for pair in itertools.combinations(range(dec.WINDOW), dec.SUBSTITUTIONS):
        assert any(
            not {at + i for i in mask} & set(pair)
            for mask in kept for at in range(dec.WINDOW - mask[-1])
        ), pair


def test_leaks_equal_brute_force(spark, documents):
    rng = random.Random(8)
    text = lambda n, v=40: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(i, text(rng.choice([13, 15, 30, 60]), 400)) for i in range(12)]
    items += [(50, "just five words as one"), (51, "too short this"), (52, None), (53, ""), (None, text(20, 400)), (54, "a " * 30)]
    docs = []
    for i in range(150):
        item = words(rng.choice(items)[1]) or ["x"]
        part = item[rng.randrange(len(item)) :][: rng.randint(5, 60)]
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = "changed"
        docs.append((i, f"{text(rng.randint(0, 60))} {' '.join(part).upper()}\n{text(rng.randint(0, 30))}"))
    docs += [(500, None), (501, ""), (502, "five JUST five words\tas one more"), (503, "a " * 40), (None, items[0][1]), (504, items[0][1]), (504, items[0][1]), (504, "clean")]
    table = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, seed string")
    found = dec.decontaminate(documents(docs), table).collect()
    assert len(found) == len(docs)
    want = sorted((i is None, i or 0, sorted(j for j, t in items if j is not None and overlapped(d, t)), not any(overlapped(d, t) for _, t in items)) for i, d in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["items"], r.kept) for r in found) == want
    left = dec.drop_leaks(documents(docs), table)
    assert left.count() == sum(x[3] for x in want) and left.columns == documents(docs).columns


def test_empty_sides(spark, documents):
    items = spark.createDataFrame([(1, "w " * 20)], "item_id long, text string")
    docs = documents([(1, "w " * 20), (2, None)])
    assert dec.decontaminate(docs.where("false"), items).count() == 0
    assert [r.kept for r in dec.decontaminate(docs, items.where("false")).collect()] == [True, True]


def test_registered_query_finds_every_verbatim_item(spark, sf):
    from edgelake.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {r.doc_id: set(r["items"]) for r in QUERIES["op5_decontaminate"](spark, sf).collect()}
    for d in docs:
        assert {i.item_id for i in items if i.text in d.text} <= got[d.doc_id]


def test_items_of_any_length_are_found(spark, documents):
    rng = random.Random(3)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 15)]
    docs, want = [], {}
    for n, item in items:
        for changed in range(3):
            part = item.split()
            for at in rng.sample(range(n), min(changed, n)):
                part[at] = "other"
            docs.append((100 * n + changed, f"a b {' '.join(part)} c d"))
            want[100 * n + changed] = [n] if changed <= (0 if n <= 4 else 1 if n < 13 else 2) else []
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r["items"] for r in dec.decontaminate(documents(docs), table).collect()} == want

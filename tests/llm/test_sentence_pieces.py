import random
import tracemalloc

import pyarrow as pa
import pytest

from edgelake.llm import sentence_pieces as sp

public_tokenizers = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "the", " ", "  ", "▁", "\n", "\t", "\r\n", "é", "ß", "漢字", "🙂", "</s>", "<0x0A>", "ing", "B", "7", "　", "́", "\x00"]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def random_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_ids_and_texts_equal_the_librarys(spark, documents, model):
    rng = random.Random(5)
    texts = [None, "", " ", "  ", "a ", " a", "▁", "a▁ b", "\n", "x" * 5000, " " * 3000]
    texts += [random_text(rng, rng.choice([1, 3, 10, 200])) for _ in range(300)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    library = sp.load(model)
    want = sorted(((i, library.encode(t or "", add_eos=True)) for i, t in rows), key=str)
    got = sp.decode(sp.encode(documents(rows), model), model).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want
    assert all(r["decoded"] == library.decode(r["ids"]) for r in got)


def test_blocks_and_long_texts(spark, documents, model, monkeypatch):
    rng = random.Random(6)
    for name, value in (("BLOCK_BYTES", 64), ("PART_CHARS", 9)):
        monkeypatch.setattr(sp, name, value)
    for _ in range(300):
        text = random_text(rng, rng.choice([1, 5, 50]))
        words = [w for part in sp.marked_words(text) for w in part]
        assert "".join(words) == " " + text.replace("▁", " ") and words == sp.MARKED.findall(" " + text.replace("▁", " "))
    monkeypatch.undo()
    text = " ".join(random_text(rng, 9) for _ in range(40_000))
    got = sp.encode(documents([(1, text), (1, text), (2, "a")]), model).collect()
    assert sorted(len(r["ids"]) for r in got)[1:] == [len(sp.load(model).encode(text)) + 1] * 2


def test_no_rows_and_columns_that_clash(spark, documents, model):
    assert sp.encode(documents([]), model).collect() == []
    rows = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, block string, ids int")
    assert [tuple(r) for r in sp.encode(rows, model).collect()] == [(1, sp.load(model).encode("a b", add_eos=True))]
    with pytest.raises(ValueError, match="decoded"):
        sp.decode(spark.createDataFrame([([1], "x")], "ids array<int>, decoded string"), model)
    kept = sp.decode(spark.createDataFrame([(None, "x")], "ids array<int>, _key string"), model).collect()
    assert [tuple(r) for r in kept] == [(None, "x", "")]


def test_models_whose_pieces_cross_words_segment_whole_texts(spark, documents, model, monkeypatch):
    monkeypatch.setattr(sp, "words_apart", lambda library: False)
    got = sp.encode(documents([(1, "a b  c"), (2, None)]), model).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == [(1, sp.load(model).encode("a b  c", add_eos=True)), (2, [2])]


def test_rows_in_another_order_are_noticed(spark, model):
    import pyarrow as pa

    at = lambda texts, cut: pa.table({
        "cut": pa.array([cut], pa.int64()), "doc_ids": [[1]], "sizes": [[1]],
        "places": [sp._packed(sp.np.zeros(1, "<u4"))], "buckets": [sp._packed(sp.np.zeros(1, "<u4"))],
    })
    lists = pa.table({"cut": pa.array([5], pa.int64()), "bucket": [0], "ids": [sp._packed(sp.np.array([1, 9]))]})
    assert sp._joined(at(["a"], 5), lists, [2]).to_pylist() == [{"doc_id": 1, "ids": [9, 2]}]
    for left, right in ((at(["a"], 6), lists), (at(["a"], 5), lists.slice(0, 0)), (at(["a"], 5).slice(0, 0), lists)):
        with pytest.raises(RuntimeError, match="another order"):
            sp._joined(left, right, [2])
    rows = spark.createDataFrame([(i, f"w{i % 7} x y") for i in range(50)], "doc_id long, text string").repartition(3)
    assert sp.encode(rows, model, store=True).count() == 50


def test_any_ids_are_decoded_as_by_the_library(spark, model, monkeypatch):
    monkeypatch.setattr(sp, "DECODED_IDS", 50)
    rng, library = random.Random(8), sp.load(model)
    some = [0, 1, 2, 3, 198, 199, 230, 258, 259, 260, library.piece_to_id("▁▁"), library.piece_to_id("▁"), 31999, 500, 29871]
    lists = [[rng.choice(some) for _ in range(rng.choice([0, 1, 2, 5, 80]))] for _ in range(500)]
    rows = spark.createDataFrame([(i, ids) for i, ids in enumerate(lists)], "n long, ids array<int>")
    got = {r["n"]: r["decoded"] for r in sp.decode(rows, model).collect()}
    assert [got[i] for i in range(len(lists))] == [library.decode(ids) for ids in lists]


def test_texts_come_with_the_ids_from_one_worker_per_task(spark, documents, model, tmp_path, monkeypatch):
    from edgelake.llm.queries import QUERIES

    rng, library = random.Random(9), sp.load(model)
    rows = [(i, t) for i, t in enumerate([None, "", " ", "a▁ b", *(random_text(rng, 30) for _ in range(60))])]
    want = {i: library.encode(t or "", add_eos=True) for i, t in rows}
    for apart in (sp.words_apart, lambda library: False):
        monkeypatch.setattr(sp, "words_apart", apart)
        got = sp.encode(documents(rows), model, decoded="a text").collect()
        assert {r["doc_id"]: r["ids"] for r in got} == want
        assert all(r["a text"] == library.decode(r["ids"]) for r in got)
    monkeypatch.undo()
    assert sp.encode(documents([]), model, decoded="x").collect() == []
    with pytest.raises(ValueError, match="ids"):
        sp.encode(documents(rows), model, decoded="ids")
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["op13_sentence_pieces"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_a_blocks_texts_are_not_all_strings_at_once(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(sp, "TaskContext", Task)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(3000)), "text": pa.array(["é漢 " + "some words " * 180] * 3000)})
    assert sum(1 for _ in sp.slices(batch.column(1), sp.BLOCK_BYTES)) == 1
    tracemalloc.start()
    try:
        assert len(list(sp._lists_of_words(iter([batch]), 8))) == 1
        assert tracemalloc.get_traced_memory()[1] < batch.nbytes / 3
    finally:
        tracemalloc.stop()

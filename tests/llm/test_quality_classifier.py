import numpy as np
import pyarrow as pa
import pytest

from edgelake.llm import quality_classifier as qc


def good(rng, n):
    return " ".join(f"{rng.choice(['the', 'of', 'house', 'river', 'green', 'walks'])}{rng.integers(50) or ''}" for _ in range(n)) + "."


def junk(rng, n):
    return " | ".join(f"{rng.choice(['win', 'click', 'buy'])}###" for _ in range(n))


@pytest.fixture
def data(spark, documents):
    rng = np.random.default_rng(4)
    rows = [(i, good(rng, rng.integers(5, 400)) if i % 4 else junk(rng, rng.integers(5, 400))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), "x") for i in range(300)] + [(None, 1, "x"), (7, None, "x"), (7, 1, "x"), (999, 0, "x")], "doc_id long, quality int, text string")
    return rows, documents(rows), labels


def test_learns_from_labels_and_scores_all_rows(documents, data):
    rows, docs, labels = data
    model = qc.fit(docs, labels.where("doc_id % 3 <> 0 OR doc_id IS NULL"))
    more = documents([*rows, (900, None), (901, ""), (901, ""), (None, " \n")])
    got = {}
    for r in qc.score(more, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    held = [i for i in range(0, 300, 3)]
    assert sum((got[i][0] >= 0.7) == (i % 4 > 0) for i in held) >= 98
    assert all(0 <= s <= 1 for x in got.values() for s in x) and got[900][0] == got[901][0] == got[901][1] == got[None][0]
    kept = qc.accept(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows if got[i][0] >= 0.7}


def test_scores_do_not_depend_on_neighbours(data):
    rows, docs, labels = data
    model = qc.fit(docs, labels)
    texts = [t for _, t in rows[:40]] + ["  lead", "", "x", " "]
    together = model.scores(pa.array(texts))
    alone = [model.scores(pa.array([t]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_attention_finds_the_bad_passage(data):
    rng = np.random.default_rng(5)
    rows, docs, labels = data
    model = qc.fit(docs, labels)
    x, doc = next(qc.parts(pa.array([good(rng, 64 * 3)])))
    assert len(x) == 3 and (doc == 0).all()
    half = model.scores(pa.array([good(rng, 128), good(rng, 128) + " " + junk(rng, 128)]))
    assert half[0] > half[1]


def test_one_kind_of_label_or_none(spark, documents):
    docs = documents([(1, "a b"), (2, "c")])
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in qc.score(docs, qc.fit(docs, ones)).collect()} == {0.75}
    assert {round(r.score, 6) for r in qc.score(docs, qc.fit(docs, ones.where("false"))).collect()} == {0.5}
    assert qc.score(docs.where("false"), qc.fit(docs.where("false"), ones)).count() == 0


def test_held_out_labels(spark):
    from edgelake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_quality_attention"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_parts_of_a_text_are_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [good(rng, 5000), None, "  \n ", "x" * 900, junk(rng, 64), " \n" + good(rng, 129) + " \t", "é ß " * 700]
    whole, of = qc.encode(qc.words_of(pa.array(texts)))
    for size in (1, 500, 4000):
        monkeypatch.setattr(qc, "PART_BYTES", size)
        x, doc = map(np.concatenate, zip(*qc.parts(pa.array(texts))))
        assert (doc == of).all() and np.allclose(x, whole, atol=1e-6)


def test_attention_equals_plain_loops():
    rng = np.random.default_rng(7)
    bags = [rng.normal(size=(n, qc.WIDTH)).astype(np.float32) for n in (1, 3, 9)]
    model = qc.train(bags, np.array([1.0, 0.0, 1.0]))
    text = good(rng, 300)
    x, _ = qc.encode(qc.words_of(pa.array([text])))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    weights, values = [], []
    for row in (x - model.mean) * model.scale:
        hidden = [np.tanh(row @ model.v[:, k]) * sigmoid(row @ model.u[:, k]) * model.w[k] for k in range(qc.ATTENTION)]
        weights.append(np.exp(sum(hidden)))
        values.append(float(row @ model.c))
    want = sigmoid(sum(w * v for w, v in zip(weights, values)) / sum(weights) + model.b)
    assert model.scores(pa.array([text]))[0] == pytest.approx(want, abs=1e-5)


def test_training_is_plain_descent_on_the_loss(monkeypatch):
    """The first step follows the gradient of the mean loss of whole bags, taken here by differences."""
    monkeypatch.setattr(qc, "EPOCHS", 0)
    rng = np.random.default_rng(8)
    bags, labels = [rng.normal(size=(n, qc.WIDTH)) for n in (2, 5, 3, 4)], np.array([1.0, 0.0, 0.0, 1.0])
    start = qc.train(bags, labels)

    def loss(c):
        out = 0.0
        for bag, y in zip(bags, labels):
            x = (bag - start.mean) * start.scale
            a = np.exp((np.tanh(x @ start.v) * qc._sigmoid(x @ start.u)) @ start.w)
            p = qc._sigmoid((a / a.sum()) @ (x @ c) + start.b)
            out -= (y * np.log(p) + (1 - y) * np.log(1 - p)) / len(bags)
        return out

    monkeypatch.setattr(qc, "EPOCHS", 1)
    step = qc.train(bags, labels).c - start.c
    slope = [(loss(start.c + d) - loss(start.c - d)) / 2e-4 for d in np.eye(qc.WIDTH)[::20] * 1e-4]
    big = np.abs(slope) > 1e-4
    assert big.sum() > 5 and (np.sign(step[::20][big]) == -np.sign(np.array(slope)[big])).all()


def test_long_texts_take_fewer_rows_and_teach_whole(spark, documents):
    rng = np.random.default_rng(9)
    rows = [(i, good(rng, 64 * 20) if i % 2 else junk(rng, 64 * 20)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    whole, qc.train = qc.train, lambda bags, labels: seen.append([len(b) for b in bags]) or whole(bags, labels)
    try:
        qc.fit(documents([*rows, (99, good(rng, 64 * 300))]), labels, train_passages=205)
    finally:
        qc.train = whole
    assert set(seen[0]) == {20, 40} and 165 < sum(seen[0]) <= 205


def test_a_very_long_text(spark, documents):
    rng = np.random.default_rng(10)
    part = good(rng, 100_000) + " "
    model = qc.fit(documents([(1, part), (2, junk(rng, 500))]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in qc.score(documents([(1, part * 40), (2, None)]), model).collect()}
    assert len(part) * 40 > 20 << 20 and abs(got[1] - model.scores(pa.array([part]))[0]) < 0.05

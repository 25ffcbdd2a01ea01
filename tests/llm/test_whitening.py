import gc
import math
import time

import numpy as np
import pytest

from edgelake.llm import whitening as wh


def expected(vectors, k=4):
    x = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in vectors]
    distinct = np.array(sorted({tuple(v) for _, v in x}), float)
    n, s = len(distinct), distinct.sum(axis=0)
    v = np.cov(distinct.T, bias=True)
    values, parts = np.linalg.eigh(v)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    rows = {}
    for i, row in x:
        deviation = sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s))
        rows.setdefault(i, []).append((n, deviation, (np.array(row) - s / n) @ parts / np.sqrt(values), values / np.trace(v)))
    return rows


@pytest.mark.parametrize("height", [3, 1024])
def test_equal_to_plain_eigenvectors(spark, monkeypatch, height):
    monkeypatch.setattr(wh, "LEAST_BLOCK_ROWS", height)
    monkeypatch.setattr(wh, "BLOCK_BYTES", 8)
    monkeypatch.setattr(wh, "PAIRS_PER_TASK", 2)
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(8, 8)) * np.arange(8, 0, -1)[:, None] ** 2 / 20
    vectors = [(i, (rng.normal(size=8) @ mixed).tolist()) for i in range(60)]
    vectors += [(60 + i, vectors[5][1]) for i in range(200)] + [(3, vectors[3][1])]
    bad = [(900, None), (901, [None] * 8), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("-inf")] + [0.0] * 7), (905, [0.5])]
    frame = spark.createDataFrame(
        [(i, v, "x", 1, "r") for i, v in vectors + bad], "vec_id long, embedding array<double>, x string, index int, component string"
    ).repartition(5)
    got, want = {}, expected(vectors)
    for r in wh.whiten(frame).collect():
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert got.keys() == want.keys()
    signs = [np.sign(got[0][c][0]["whitened"] * want[0][0][2][c - 1]) for c in range(1, 5)]
    for i, rows in want.items():
        assert sorted(got[i]) == [1, 2, 3, 4] and all(len(r) == len(rows) for r in got[i].values())
        n, deviation, whitened, explained = rows[0]
        for c in range(1, 5):
            for r in got[i][c]:
                assert (r["n"], r["deviation"]) == (n, deviation)
                assert r["whitened"] * signs[c - 1] == pytest.approx(whitened[c - 1], abs=1e-8)
                assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
                assert r["identity_error"] < 1e-8


def test_few_components_and_none(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    line = wh.whiten(frame([(1, [0.0, 0.0]), (2, [1.0, 2.0]), (None, [2.0, 4.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in line) == [(0, 1), (1, 1), (2, 1)]
    assert {round(r["explained"], 9) for r in line} == {1.0}
    assert wh.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert wh.whiten(frame([(1, []), (2, None)])).collect() == [] and wh.whiten(frame([])).collect() == []


def test_the_matrix_outlives_a_pause_before_its_rows_are_read(spark, monkeypatch):
    """py4j lets go of what Python has dropped in a thread of its own; a pause gives it the time."""
    call = wh.callMLlibFunc
    monkeypatch.setattr(wh, "callMLlibFunc", lambda *a: (gc.collect(), time.sleep(2), call(*a))[2])
    vectors = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(30)], "vec_id long, embedding array<float>")
    assert wh.whiten(vectors).count() == 60

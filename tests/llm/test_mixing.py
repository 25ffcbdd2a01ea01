from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgelake.llm import mixing


def test_targets_share_the_excess(spark):
    rows = [("a", 1, 100), ("b", 1, 1000), ("c", 1, 10_000), (None, 1, 50)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, n_docs long, source_size long")).collect()}
    assert got["a"].target == 300 and got["b"].target == 3000 and got[None].target == 150
    assert got["c"].target == pytest.approx(11_150 - 3450)
    assert [got[s].weight for s in ("a", "b", "c", None)] == [5, 2, 1, 5]


@pytest.mark.parametrize("total,good,draws", [(20, 7, 9), (1000, 300, 500), (5, 5, 2), (5, 0, 3), (0, 0, 0)])
def test_hypergeometric_has_the_right_mean(spark, total, good, draws):
    u = (F.col("id") + 0.5) / 4000
    x = mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(draws), u)
    r = spark.range(4000).select(x.alias("x")).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x"), F.max("x")).first()
    mean = draws * good / total if total else 0
    variance = mean * (1 - good / total) * (total - draws) / (total - 1) if total > 1 else 0
    assert r.m == pytest.approx(mean, abs=0.02) and r.v == pytest.approx(variance, rel=0.05, abs=0.02)
    assert max(0, draws + good - total) <= r[2] and r[3] <= min(good, draws)


def test_tree_keeps_quotas_exactly(spark):
    quotas = {0: 1000, 1: 37, 2: 0, 3: 4096}
    got = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "turn int, quota long"), levels=4).collect()
    sums, shards = Counter(), Counter()
    for r in got:
        assert r.quota >= 0
        sums[r.turn] += r.quota
        shards[r.shard] += r.quota
    assert {k: sums[k] for k in quotas} == quotas
    assert len(shards) == 16 and max(shards.values()) - min(shards.values()) <= 4


def test_mix_meets_its_targets(documents):
    rows = [(i, "w " * (i % 50 + 1), None, "big") for i in range(3000)]
    rows += [(5000 + i, "w " * 20, None, f"s{i % 4}") for i in range(400)]
    rows += [(None, None, None, "big"), (9000, "", None, None), (9001, "a b", None, None), (9001, "a b", None, None)]
    plan = mixing.mix(documents(rows)).collect()
    assert len(plan) == len(rows)
    taken, target, sizes = Counter(), {}, Counter()
    for r in plan:
        assert r.taken == r.size * r.copies and r.copies <= 3 and len(r.shards) == r.copies
        assert all(0 <= s < 64 for s in r.shards)
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        target[r.source] = r.target
    for s in target:
        assert target[s] <= 3 * sizes[s] and abs(taken[s] - target[s]) <= 50
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(documents(rows).repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.copies, r.shards)
    assert sorted(map(key, plan)) == sorted(map(key, again))


def test_shards_take_what_the_tree_gives_them(documents):
    rows = [(i, "w", None, "abc"[i % 3]) for i in range(3000)]
    docs = documents(rows)
    copies = mixing.mixed_copies(docs).collect()
    plan = mixing.mix(docs).collect()
    assert len(copies) == sum(r.copies for r in plan) and len({(r.doc_id, r.copy) for r in copies}) == len(copies)
    assert Counter((r.doc_id, r.shard) for r in copies) == Counter((r.doc_id, s) for r in plan for s in r.shards)


def test_nothing_is_drawn_without_quotas(documents, monkeypatch):
    real = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: real(*a).withColumn("quota", F.lit(0).cast("bigint")))
    docs = documents([(i, "w", None, "ab"[i % 2]) for i in range(50)])
    assert {(r.copies, tuple(r.shards)) for r in mixing.mix(docs).collect()} == {(0, ())}


def test_copies_are_shuffled_in_parts_of_a_shard(documents):
    docs = documents([(i, "w", None, "a") for i in range(2000)] + [(None, "x", None, "a"), (None, "y", None, "a")])
    whole = mixing.mixed_copies(docs).collect()
    cut = mixing.mixed_copies(docs, part_copies=5).collect()
    key = lambda r: (r.shard, r.doc_id is None, r.doc_id or 0, r.text, r["copy"])
    assert sorted(map(key, whole)) == sorted(map(key, cut))
    ids = [r.doc_id for r in whole if r.doc_id is not None]
    assert ids != sorted(ids)


def test_ids_that_leave_blocks_empty(documents):
    plan = mixing.mix(documents([(None, "w", None, "a")] * 700 + [(1, "w " * 300, None, "b")])).collect()
    assert all(0 <= s < 64 for r in plan for s in r.shards) and all(len(r.shards) == r.copies for r in plan)


def test_mixed_documents_keep_their_columns(documents):
    docs = documents([(1, "a b", "en", "x"), (None, "c", "en", "x"), (None, "d", "en", "y")])
    got = mixing.mixed_documents(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert mixing.mixed_documents(docs.where("false")).count() == mixing.mix(docs.where("false")).count() == 0

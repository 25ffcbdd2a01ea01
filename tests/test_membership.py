"""Membership filters: no member is ever missed, sizes and rates are as computed."""

import pytest
from frames import rows
from pyspark.sql import functions as F

from edgelake.functions import sketch
from edgelake.operators import membership as m
from edgelake.operators import topology


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(1, 20001).select(F.col("id").alias("x")).cache()


def test_counting_filter_on_the_standard_probe(numbers):
    """1 to 10,000 in, 10,001 to 20,000 probed, 14 bits per entry."""
    bits, hashes = 14 * 10_000, sketch.bloom_hash_count(14)
    cbf = m.cbf_build(numbers.where("x <= 10000"), [], "x", bits, hashes).cache()
    found = m.cbf_semi_join(numbers, cbf, [], "x", bits, hashes)
    assert found.where("x <= 10000").count() == 10_000
    assert found.where("x > 10000").count() < 40
    assert cbf.agg(F.sum("cnt")).first()[0] == 10_000 * hashes


def test_small_filter_misses_nothing(spark):
    members = spark.range(1024).select((F.col("id") * 2654435761 % 1_000_003).alias("x"))
    bits, hashes = 11 * 1024, sketch.bloom_hash_count(11)
    cbf = m.cbf_build(members, [], "x", bits, hashes)
    assert m.cbf_semi_join(members, cbf, [], "x", bits, hashes).count() == 1024


def test_delete_takes_back_an_insert(numbers):
    size = (14 * 1000, 10)
    first, second = numbers.where("x <= 600"), numbers.where("x > 600 AND x <= 1000")
    both = m.cbf_merge(m.cbf_build(first, [], "x", *size), m.cbf_build(second, [], "x", *size))
    assert rows(both, "pos", "cnt") == rows(m.cbf_build(first.union(second), [], "x", *size), "pos", "cnt")
    left = m.cbf_delete(both, second, [], "x", *size)
    assert rows(left, "pos", "cnt") == rows(m.cbf_build(first, [], "x", *size), "pos", "cnt")
    unknown = numbers.where("x > 15000 AND x <= 15020")
    assert rows(m.cbf_delete(left, unknown, [], "x", *size), "pos", "cnt") == rows(left, "pos", "cnt")


def test_deletes_count_repeats(spark):
    size = (1 << 12, 7)
    twice = spark.createDataFrame([(5,), (5,), (6,)], "x long")
    cbf = m.cbf_build(twice, [], "x", *size)
    once = m.cbf_delete(cbf, twice.where("x = 5").limit(1), [], "x", *size)
    assert rows(m.cbf_semi_join(twice.distinct(), once, [], "x", *size)) == [(5,), (6,)]
    none = m.cbf_delete(cbf, twice.where("x = 5"), [], "x", *size)
    assert rows(m.cbf_semi_join(twice.distinct(), none, [], "x", *size)) == [(6,)]
    more = m.cbf_delete(cbf, twice.where("x = 5").union(twice.where("x = 5")), [], "x", *size)
    assert rows(more, "pos", "cnt") == rows(m.cbf_build(twice.where("x = 6"), [], "x", *size), "pos", "cnt")


def test_probes_of_small_filters_are_not_shuffled(spark, numbers, monkeypatch):
    cbf = m.cbf_build(numbers.where("x <= 100"), [], "x", 4096, 5)
    grouped = m.cbf_build(numbers.where("x <= 100").withColumn("g", F.col("x") % 2), ["g"], "x", 4096, 5)
    probes = numbers.withColumn("g", F.col("x") % 2)
    found = m.cbf_semi_join(probes, grouped, ["g"], "x", 4096, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(g" not in plan.split("BroadcastExchange")[0]
    packed = rows(found, "g", "x"), rows(m.cbf_semi_join(numbers, cbf, [], "x", 4096, 5))
    monkeypatch.setattr(m, "FILTER_BYTES", 0)
    assert packed == (rows(m.cbf_semi_join(probes, grouped, ["g"], "x", 4096, 5), "g", "x"), rows(m.cbf_semi_join(numbers, cbf, [], "x", 4096, 5)))


def test_fingerprints_insert_search_delete(numbers):
    members = numbers.where("x <= 10000")
    qf = m.qf_build(members.union(members.where("x <= 10")), [], "x", 40)
    assert m.qf_semi_join(numbers, qf, [], "x", 40).count() == 10_000
    once = m.qf_delete(qf, members, [], "x", 40)
    assert rows(m.qf_semi_join(numbers, once, [], "x", 40)) == [(i,) for i in range(1, 11)]
    assert m.qf_delete(once, members.where("x <= 10"), [], "x", 40).count() == 0


def test_short_fingerprints_collide_as_expected(numbers):
    qf = m.qf_build(numbers.where("x <= 1000"), [], "x", 14)
    hits = m.qf_semi_join(numbers.where("x > 1000"), qf, [], "x", 14).count()
    assert 700 < hits < 1600  # 19,000 probes at about 1,000 / 2^14


def test_sizes(spark):
    assert sketch.bloom_bits_per_entry(0.01) == 10
    assert sketch.bloom_hash_count(14) == 10
    row = spark.range(1).select(sketch.fingerprint_bits(F.lit(1000), 0.01).alias("b")).first()
    assert row["b"] == 17


def test_trees_find_all_holders(spark):
    nodes = spark.createDataFrame([(i, 40) for i in range(6)], "node_id int, capacity int")
    edges = topology.undirected(
        spark.createDataFrame([(0, 1), (0, 3), (1, 2), (1, 5), (2, 4), (2, 5), (3, 4)], "src int, dst int")
    )
    near = topology.neighborhood(topology.hop_distances(edges, nodes, 2), nodes, 2).cache()
    held = spark.range(200).select(
        (F.col("id") % 6).cast("int").alias("node_id"), (F.col("id") % 90).alias("object_id")
    ).distinct()
    probes = near.select("viewer").distinct().join(held.select("object_id").distinct())
    want = rows(near.join(held, "node_id").select("viewer", "object_id", "hop", "node_id"))
    cbf = m.cbf_tree(held, near, 4096, 6)
    assert rows(m.cbf_tree_search(probes, cbf, near, 4096, 6)) == want
    qf = m.qf_tree(held, near, 1e-6)
    assert rows(m.qf_tree_search(probes, qf, near, 1e-6)) == want
    sizes = m.cbf_tree_bits(near, 4096).where("viewer = 0").first()
    assert sizes["filters"] == 1 + 2 + 5 and sizes["bits"] == 8 * 9 * 4096


@pytest.fixture(scope="module")
def tree(spark):
    ends = F.explode(F.array(*[((F.col("id") * a + b) % 90).cast("int") for a, b in ((1, 1), (7, 1), (11, 5))]))
    edges = topology.undirected(spark.range(90).select(F.col("id").cast("int").alias("src"), ends.alias("dst")))
    nodes = spark.range(90).select(F.col("id").cast("int").alias("node_id"), F.lit(9).alias("capacity"))
    near = topology.neighborhood(topology.hop_distances(edges, nodes, 4), nodes, 4).cache()
    held = spark.range(1200).select((F.col("id") % 90).cast("int").alias("node_id"), (F.col("id") * 31 % 211).alias("object_id")).distinct().cache()
    assert near.groupBy("viewer").count().agg(F.max("count")).first()[0] > 64, "more filters than a word has bits"
    return held, near


@pytest.mark.parametrize("room", [m.FILTER_BYTES, 0])
def test_sliced_index_names_every_filter_that_answers(spark, tree, room, monkeypatch):
    monkeypatch.setattr(m, "FILTER_BYTES", room)
    held, near = tree
    size = (256, 3)
    filters = m.cbf_tree(held, near, *size)
    probes = spark.range(400).select((F.col("id") % 7).cast("int").alias("viewer"), (F.col("id") * 3 % 500).alias("object_id"))
    found = m.cbf_tree_search(probes.unionAll(probes), filters, near, *size)
    places = {r["object_id"]: set(r["p"]) for r in probes.select("object_id", sketch.bloom_positions(F.col("object_id"), *size).alias("p")).collect()}
    sets = {}
    for r in filters["leaf"].where("cnt > 0").collect():
        sets.setdefault((r["viewer"], r["hop"], r["node_id"]), set()).add(r["pos"])
    asked = {(r["viewer"], r["object_id"]) for r in probes.collect()}
    want = sorted((v, o, hop, n) for (v, hop, n), s in sets.items() for w, o in asked if w == v and places[o] <= s)
    assert rows(found, "viewer", "object_id", "hop", "node_id") == want and len(want) > 100
    negatives = spark.range(1000, 1300).select(F.col("id").alias("object_id"))
    far = [set(r["p"]) for r in negatives.select(sketch.bloom_positions(F.col("object_id"), *size).alias("p")).collect()]
    wanted = {}
    for kind, keys in m.LEVELS.items():
        above = {}
        for r in near.collect():
            above.setdefault(tuple(r[k] for k in keys), set()).update(sets.get((r["viewer"], r["hop"], r["node_id"]), ()))
        for key, s in above.items():
            wanted.setdefault(key[0], {}).setdefault(kind, []).append(sum(p <= s for p in far) / len(far))
    for r in m.cbf_tree_fpr(negatives, filters, near, *size).collect():
        w = wanted[r["viewer"]]
        level = (sum(w["level"]) + w["root"][0]) / (len(w["level"]) + 1)
        assert r["root_fpr"] == pytest.approx(w["root"][0]) and r["level_fpr"] == pytest.approx(level)
        assert r["all_fpr"] == pytest.approx((sum(w["leaf"]) / len(w["leaf"]) + w["root"][0] + level) / 3)


def test_probes_of_a_packed_index_move_once(spark, tree):
    held, near = tree
    index = m.TreeIndex(m.cbf_tree(held, near, 256, 3), near, 256, 3)
    probes = held.withColumnRenamed("node_id", "viewer")
    plan = index.answers(probes, "object_id", by_viewer=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("InMemoryRelation")[0]

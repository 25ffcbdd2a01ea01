"""Topology and dedup on small graphs, against a step-by-step sweep."""

import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from edgelake.operators import dedup, metrics, node_maps, placement, topology

# A graph of six nodes and the hops from node 0.
EDGES = [(0, 1), (0, 3), (1, 2), (1, 5), (2, 4), (2, 5), (3, 4)]
HOPS_FROM_0 = {0: 0, 1: 1, 2: 2, 3: 1, 4: 2, 5: 2}


@pytest.fixture(scope="module")
def graph(spark):
    edges = topology.undirected(spark.createDataFrame(EDGES, "src int, dst int")).cache()
    nodes = spark.createDataFrame([(i, 4) for i in range(6)], "node_id int, capacity int").cache()
    return edges, nodes


@pytest.mark.parametrize("max_hop", [4, 6, None])
def test_hops(graph, max_hop):
    hops = topology.hop_distances(*graph, max_hop)
    assert {r["dst"]: r["hop"] for r in hops.where("src = 0").collect()} == HOPS_FROM_0
    assert hops.count() == 36


def test_hops_stop_at_the_limit(graph):
    assert topology.hop_distances(*graph, 1).agg(F.max("hop")).first()[0] == 1


def test_search_of_5000_nodes_moves_bitmaps(spark):
    """A ring of 5,000 nodes with five chords each: rows of the largest round against its pairs of nodes, and some sources by hand."""
    n = 5000
    ring = spark.range(n).select(F.col("id").cast("int").alias("src"), F.explode(F.array(*[
        F.pmod(F.col("id") * a + b, F.lit(n)).cast("int") for a, b in ((1, 1), (7, 3), (13, 5), (101, 11), (333, 7), (1009, 2))
    ])).alias("dst"))
    edges = topology.undirected(ring).cache()
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node_id"))
    positions = topology.node_positions(nodes)
    found = topology.reached_sources(edges, positions).cache()
    rounds = found.groupBy("hop").agg(F.sum(F.bit_count("bits")).alias("pairs"), F.count("bits").alias("rows")).collect()
    assert sum(r["pairs"] for r in rounds) == n * n
    largest = max(rounds, key=lambda r: r["pairs"])
    assert largest["pairs"] / largest["rows"] >= 30, rounds
    around = {}
    for r in edges.collect():
        around.setdefault(r["src"], set()).add(r["dst"])
    for source in (0, 63, 64, 4999):
        level, hop, want = {source}, 0, {}
        while level:
            want |= {m: hop for m in level}
            level, hop = {k for m in level for k in around[m] if k not in want}, hop + 1
        bit = F.call_function("shiftright", "bits", F.lit(source % 64)).bitwiseAND(1) == 1
        got = found.where((F.col("block") == source // 64) & bit).select("node_id", "hop").collect()
        assert {r["node_id"]: r["hop"] for r in got} == want and len(got) == n


def test_tree_takes_the_parent_queued_first(graph):
    tree = topology.shortest_path_trees(*graph, 6).where("source = 0")
    assert rows(tree, "node_id", "parent", "hop") == [(1, 0, 1), (2, 1, 2), (3, 0, 1), (4, 3, 2), (5, 1, 2)]


def test_index_round_trip(spark, graph):
    """Node i holds object i; node 0 finds each at its node, and none after they are deleted."""
    hops = topology.hop_distances(*graph, 2)
    near = topology.neighborhood(hops, graph[1], 2)
    held = spark.createDataFrame([(i, i) for i in range(1, 6)], "node_id int, object_id long")
    found = placement.holders(held, near).where("viewer = 0")
    assert rows(found, "object_id", "min_hop") == [(i, HOPS_FROM_0[i]) for i in range(1, 6)]
    assert [r["holders"] for r in found.orderBy("object_id").collect()] == [[i] for i in range(1, 6)]
    assert placement.holders(placement.delete_rows(held, held), near).count() == 0


def sweep(tables, near, turns, viral=()):
    """Node after node: candidates, then permissions, then drops that later nodes see."""
    tables = {n: set(objects) for n, objects in tables.items()}
    dropped, asked = [], 0
    for node in sorted(turns):
        seen = lambda viewer, o: sum(o in tables[m] for m in near[viewer])
        candidates = [o for o in tables[node] if seen(node, o) > 0]
        asked += len(candidates)
        allowed = [o for o in candidates if all(seen(m, o) > 1 for m in near[node])]
        for o in allowed:
            if o not in viral:
                tables[node].discard(o)
                dropped.append((node, o))
    return sorted(dropped), asked


def random_case(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 9)
    near = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if rng.random() < 0.45:
                near[i].add(j)
                near[j].add(i)
    tables = {i: {o for o in range(12) if rng.random() < 0.6} for i in range(n)}
    return near, tables


@pytest.mark.parametrize("seed", range(6))
def test_sweep_equals_the_step_by_step_one(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(node_maps, "MAP_BYTES", 0)
    near, tables = random_case(seed)
    viral = {0, 5}
    neighbors = spark.createDataFrame(
        [(i, j, 1, 20) for i in near for j in near[i]] or [(0, 0, 0, 0)], "viewer int, node_id int, hop int, capacity int"
    ).where("hop > 0")
    held = spark.createDataFrame([(i, o) for i in tables for o in tables[i]], "node_id int, object_id long")
    limit = 0.4
    nodes = spark.createDataFrame([(i, 12) for i in near], "node_id int, capacity int")
    turns = [i for i in near if len(tables[i]) / 12 >= limit]
    for protected in ((), viral):
        want, asked = sweep(tables, near, turns, protected)
        keep = spark.createDataFrame([(o,) for o in protected], "object_id long") if protected else None
        plan = dedup.sweep_plan(held, neighbors, nodes, limit, keep)
        assert rows(plan.where("dropped = 1"), "node_id", "object_id") == want
        assert plan.agg(F.sum("candidate")).first()[0] == asked


@pytest.mark.parametrize("seed", range(4))
def test_permission_by_definition(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(node_maps, "MAP_BYTES", 0)
    near, tables = random_case(seed)
    neighbors = spark.createDataFrame(
        [(i, j, 1, 20) for i in near for j in near[i]], "viewer int, node_id int, hop int, capacity int"
    )
    held = spark.createDataFrame([(i, o) for i in tables for o in tables[i]], "node_id int, object_id long")
    want = sorted(
        (i, o, int(all(sum(o in tables[k] for k in near[m]) > 1 for m in near[i]))) for i in tables for o in tables[i]
    )
    assert rows(dedup.delete_permission(held, neighbors), "node_id", "object_id", "permitted") == want


def test_latency_sweep_passes_nodes_below_the_limit(spark, graph):
    edges, nodes = graph
    hops = topology.hop_distances(edges, nodes, None)
    near = topology.neighborhood(hops, nodes, 2)
    held = spark.createDataFrame([(i, o) for i in range(6) for o in range(2)], "node_id int, object_id long")
    same = dedup.dedup_latency_sweep(held, near, hops, nodes, 0.9, [0, 1])
    assert same.count() == held.count()
    fewer = dedup.dedup_latency_sweep(held, near, hops, nodes, 0.5, [0, 1])
    assert fewer.count() < held.count()


def turn_by_turn(near, tables, hop, capacity, limit, initiators, viral=()):
    """One initiator after the other: of every object it shares, the farthest copy that may go."""
    left, open_ = {i: set(tables[i]) for i in tables}, []
    for i in initiators:
        open_.append(len(left[i]) / capacity >= limit)
        if not open_[-1]:
            continue
        seen = lambda viewer, o: sum(o in left[m] for m in near[viewer])
        far = lambda m: (sum(hop[s, m] for s in near[i] | {i}), m)  # noqa: B023, E731
        may = {o: [m for m in near[i] if o in left[m] and all(seen(k, o) > 1 for k in near[m])] for o in left[i]}
        for o, m in [(o, max(found, key=far)) for o, found in may.items() if found and o not in viral]:
            left[m].discard(o)
    return left, open_


def hops_of(near):
    out = {}
    for source in near:
        level, hop = {source}, 0
        while level:
            out |= {(source, m): hop for m in level}
            level, hop = {k for m in level for k in near[m] if (source, k) not in out}, hop + 1
    return out


@pytest.mark.parametrize("map_bytes", [node_maps.MAP_BYTES, 0])
def test_latency_sweep_over_all_nodes_equals_one_turn_after_the_other(spark, map_bytes, monkeypatch):
    """300 random graphs side by side in one topology, half of them with protected objects."""
    monkeypatch.setattr(node_maps, "MAP_BYTES", map_bytes)
    held, near, hops, nodes, want, gates, viral = [], [], [], [], [], [], []
    for seed in range(300):
        around, tables = random_case(seed)
        hop, base = hops_of(around), 100 * seed
        spared = {0, 5} if seed % 2 else set()
        order = sorted(around)
        left, open_ = turn_by_turn(around, tables, hop, 12, 0.5, order, spared)
        held += [(base + i, base + o) for i in tables for o in tables[i]]
        near += [(base + i, base + j, 1, 12) for i in around for j in around[i]]
        hops += [(base + i, base + j, h) for (i, j), h in hop.items()]
        nodes += [(base + i, 12) for i in around]
        viral += [(base + o,) for o in spared]
        want += [(base + i, base + o) for i in left for o in left[i]]
        gates += open_
    frames = [
        spark.createDataFrame(held, "node_id int, object_id long"),
        spark.createDataFrame(near, "viewer int, node_id int, hop int, capacity int"),
        spark.createDataFrame(hops, "src int, dst int, hop int"),
        spark.createDataFrame(nodes, "node_id int, capacity int"),
    ]
    found = dedup.latency_sweep(*frames, 0.5, [n for n, _ in nodes], spark.createDataFrame(viral, "object_id long"))
    assert rows(found.placement, "node_id", "object_id") == sorted(want)
    assert [r["open"] for r in found.gates.orderBy("turn").collect()] == gates
    assert len(want) < len(held) and not all(gates) and 1 < found.passes < 10


def test_turns_may_repeat_and_come_in_any_order(spark):
    around, tables = random_case(3)
    hop, order = hops_of(around), [2, 0, 2, 1, 0]
    left, open_ = turn_by_turn(around, tables, hop, 12, 0.3, order)
    found = dedup.latency_sweep(
        spark.createDataFrame([(i, o) for i in tables for o in tables[i]], "node_id int, object_id long"),
        spark.createDataFrame([(i, j, 1, 12) for i in around for j in around[i]], "viewer int, node_id int, hop int, capacity int"),
        spark.createDataFrame([(i, j, h) for (i, j), h in hop.items()], "src int, dst int, hop int"),
        spark.createDataFrame([(i, 12) for i in around], "node_id int, capacity int"), 0.3, order,
    )
    assert rows(found.placement, "node_id", "object_id") == sorted((i, o) for i in left for o in left[i])
    assert [r["open"] for r in found.gates.orderBy("turn").collect()] == open_


def test_an_object_on_all_of_2000_nodes(spark, monkeypatch):
    """A ring with steps of one and two: every copy may go at first, and the sweep leaves every node seeing two."""
    n = 2000
    near = {i: {(i + d) % n for d in (-2, -1, 1, 2)} for i in range(n)}
    held = spark.range(n).select(F.col("id").cast("int").alias("node_id"), F.lit(7).cast("bigint").alias("object_id"))
    pairs = [(i, j, 1, 1) for i in near for j in near[i]]
    neighbors = spark.createDataFrame(pairs, "viewer int, node_id int, hop int, capacity int")
    permission = dedup.delete_permission(held, neighbors)
    assert "neighbors" not in permission._jdf.queryExecution().optimizedPlan().toString()
    assert permission.where("permitted = 1").count() == n
    assert placement.duplicate_candidates(held, neighbors).count() == n
    nodes = held.select("node_id", F.lit(1).alias("capacity"))
    gone = {r["node_id"] for r in dedup.dedup_basic(held, neighbors, nodes, 1.0).collect()}
    alive = set(range(n))
    for i in range(n):
        if near[i] & alive and all(len(near[m] & alive) > 1 for m in near[i]):
            alive.discard(i)
    assert gone == set(range(n)) - alive


def test_a_registered_sweep_runs_every_node(spark, sf, monkeypatch):
    from edgelake.plans import fixtures, queries

    seen = []
    sweep_of = dedup.latency_sweep
    monkeypatch.setattr(dedup, "latency_sweep", lambda *a: seen.append(list(a[5])) or sweep_of(*a))
    for name in ("dedup_latency_sweep", "dedup_latency_sweep_all", "dedup_latency_gates"):
        queries.QUERIES[name](spark, sf)
    assert seen == [list(range(fixtures.N_NODES))] * 3


def replay(log, near, capacity, cloud):
    """Requests one by one: measure, then keep the object while there is room."""
    tables, inserted, out = {n: [] for n in near}, [], []
    for line, node, obj in log:
        if obj in tables[node]:
            distance = 0
        else:
            distance = min([hop for m, hop in near[node].items() if obj in tables[m]], default=cloud)
        out.append((line, distance))
        if obj not in tables[node] and len(tables[node]) < capacity[node]:
            tables[node].append(obj)
            inserted.append((node, obj, line))
    return out, sorted(inserted)


@pytest.mark.parametrize("seed", range(3))
def test_placement_and_distance_equal_a_replay(spark, graph, seed):
    rng = random.Random(seed)
    edges, _ = graph
    capacity = {i: rng.randint(1, 6) for i in range(6)}
    nodes = spark.createDataFrame(list(capacity.items()), "node_id int, capacity int")
    hops = topology.hop_distances(edges, nodes, 2)
    near = {i: {} for i in range(6)}
    for r in hops.where("hop > 0").collect():
        near[r["src"]][r["dst"]] = r["hop"]
    log = [(i, rng.randrange(6), rng.choice([0, 0, 0, *range(12)])) for i in range(1, 200)]
    requests = spark.createDataFrame(log, "line_no long, node_id int, object_id long").withColumn("operation", F.lit("get"))
    want, inserted = replay(log, near, capacity, 9)
    kept = placement.first_touch_placement(requests, nodes)
    assert rows(kept, "node_id", "object_id", "insert_line") == inserted
    measured = placement.nearest_replica_asof(requests, kept, topology.neighborhood(hops, nodes, 2), 9)
    assert rows(measured, "line_no", "distance") == want


def test_thrashing_counts_the_latest_earlier_eviction_only(spark):
    requests = spark.createDataFrame([(10, 1), (14, 1), (15, 1), (20, 1), (12, 2)], "line_no long, object_id long")
    evictions = spark.createDataFrame([(1, 10), (1, 10), (1, 15), (2, 12)], "object_id long, line_no long")
    marked = metrics.mark_thrashing(requests.withColumn("distance", F.lit(9)), evictions, 5, 9)
    assert rows(marked, "object_id", "line_no", "thrash") == [
        (1, 10, 0), (1, 14, 1), (1, 15, 1), (1, 20, 1), (2, 12, 0)
    ]
    near = metrics.mark_thrashing(requests.withColumn("distance", F.lit(1)), evictions, 5, 9)
    assert near.agg(F.sum("thrash")).first()[0] == 0


def test_metrics_of_no_requests(spark):
    none = spark.createDataFrame([], "distance int, viral int, thrash int")
    row = metrics.request_metrics(none, 1, 10).first()
    assert row["total_requests"] == 0 and row["edge_hit_ratio"] == 0.0 and row["avg_viral_latency"] == 0.0

"""SQL texts of the same views, as common table expressions."""

from __future__ import annotations

from edgelake.plans.fixtures import CLOUD_HOP, DAY, EDGE_MAX_HOP, LIMIT, MAX_HOP, N_NODES, THRASH_LINES

# name: (names it reads, query)
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, text: str, *needs: str) -> None:
    VIEWS[name] = (list(needs), text)


def sql(text: str, *needs: str) -> str:
    """A query with the views it reads put in front, in order of need."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for need in VIEWS[name][0]:
            add(need)
        done.append(name)

    for need in needs:
        add(need)
    if not done:
        return text
    parts = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in done)
    return f"WITH RECURSIVE {parts}\n{text}"


view(
    "requests",
    f"""SELECT event_id AS line_no, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS object_id,
        CAST(user_id % {N_NODES} AS INTEGER) AS node_id,
        CASE WHEN event_type IN ('view', 'click') THEN 'get' ELSE event_type END AS operation
    FROM events""",
)
view("gets", "SELECT * FROM requests WHERE operation = 'get'", "requests")
view(
    "lines",
    """SELECT line_no, CASE
          WHEN line_no = 1 THEN 'time ' || plain
          WHEN line_no % 19 = 4 THEN '   '
          WHEN line_no % 11 = 7 THEN line_no || ',obj-short,0,7,8,'
          WHEN line_no % 7 = 2 THEN '  ' || replace(plain, ' ', ' , ')
          WHEN line_no % 7 = 3 THEN replace(plain, ' ', ',')
          ELSE plain END AS value
    FROM (SELECT event_id + 1 AS line_no,
            (event_id + 1) || ' obj-' || json_extract_string(props, '$.k') || ' 0 1024 ' ||
            CASE WHEN event_id % 13 = 5 THEN 'u' || user_id ELSE CAST(user_id - 50 AS VARCHAR) END || ' ' ||
            CASE WHEN event_type IN ('view', 'click')
                 THEN CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'get' END
                 ELSE event_type END AS plain
          FROM events)""",
)


def counts_sql(seconds: int) -> str:
    return f"""SELECT CAST(floor(epoch(ts) / {seconds}) AS BIGINT) AS window_index, object_id AS curr_object_id,
        count(DISTINCT node_id) AS active_edges_count, count(*) AS req_count_current
    FROM gets GROUP BY 1, 2"""


def features_sql(counts: str, seconds: int) -> str:
    return f"""SELECT c.window_index, CAST(((c.window_index * {seconds}) // 3600) % 24 AS INTEGER) AS hour_of_day,
        sin(2 * pi() * (((c.window_index * {seconds}) // 3600) % 24) / 24) AS hour_sin,
        cos(2 * pi() * (((c.window_index * {seconds}) // 3600) % 24) / 24) AS hour_cos,
        c.curr_object_id, c.active_edges_count, c.req_count_current,
        coalesce(p.req_count_current, 0) AS req_count_previous,
        (c.req_count_current - coalesce(p.req_count_current, 0)) / (coalesce(p.req_count_current, 0) + 1)
            AS growth_rate
    FROM {counts} c LEFT JOIN {counts} p
      ON p.curr_object_id = c.curr_object_id AND p.window_index = c.window_index - 1"""


view("counts15", counts_sql(900), "gets")
view("counts_day", counts_sql(DAY), "gets")
view("features15", features_sql("counts15", 900), "counts15")
view("features_day", features_sql("counts_day", DAY), "counts_day")
def closed_sql(source: str) -> str:
    return f"""SELECT f.* FROM {source} f, (SELECT max(window_index) AS m FROM {source})
    WHERE window_index >= m - 96 AND window_index < m"""


def label_sql(source: str) -> str:
    return f"""SELECT f.*, CAST(f.req_count_current >= l.p95_limit AND f.req_count_current >= g.count_floor AS INTEGER)
        AS is_viral_now
    FROM {source} f
    JOIN (SELECT window_index, quantile_disc(req_count_current, 0.95) AS p95_limit FROM {source} GROUP BY 1) l
      USING (window_index),
    (SELECT quantile_disc(req_count_current, 0.75) AS count_floor FROM {source}) g"""


view("labeled", label_sql("features_day"), "features_day")


def gold_sql(closed: str, source: str) -> str:
    return f"""SELECT a.window_index, a.hour_of_day, a.hour_sin, a.hour_cos, a.curr_object_id, a.active_edges_count,
        a.req_count_current, a.req_count_previous, a.growth_rate,
        coalesce(b.is_viral_now, 0) AS is_viral_next_window
    FROM labeled_{closed} a LEFT JOIN labeled_{closed} b
      ON b.curr_object_id = a.curr_object_id AND b.window_index = a.window_index + 1
    WHERE a.window_index < (SELECT max(window_index) - 1 FROM {source})
      AND (SELECT count(DISTINCT window_index) FROM {closed}) > 1"""


for closed, source, gold in (("closed", "features_day", "gold"), ("closed15", "features15", "gold15")):
    view(closed, closed_sql(source), source)
    view(f"labeled_{closed}", label_sql(closed), closed)
    view(gold, gold_sql(closed, source), f"labeled_{closed}", closed, source)
view(
    "flags",
    f"""SELECT curr_object_id AS object_id, make_timestamp(CAST((window_index + 1) * {DAY} * 1000000 AS BIGINT)) AS scored_at
    FROM labeled WHERE is_viral_now = 1""",
    "labeled",
)
view("hot", "SELECT object_id FROM flags WHERE scored_at = (SELECT max(scored_at) FROM flags)", "flags")

view(
    "nodes",
    "SELECT n_nationkey AS node_id, CAST(40 + (n_nationkey * 7) % 30 AS INTEGER) AS capacity FROM nation",
)
view(
    "edges",
    f"""SELECT DISTINCT src, dst FROM (
      SELECT node_id AS src, CAST((node_id + 1) % {N_NODES} AS INTEGER) AS dst FROM nodes
      UNION ALL SELECT CAST((node_id + 1) % {N_NODES} AS INTEGER), node_id FROM nodes
      UNION ALL SELECT node_id, CAST((node_id * 7 + 3) % {N_NODES} AS INTEGER) FROM nodes
      UNION ALL SELECT CAST((node_id * 7 + 3) % {N_NODES} AS INTEGER), node_id FROM nodes) WHERE src <> dst""",
    "nodes",
)
view(
    "walks",
    """SELECT node_id AS src, node_id AS dst, 0 AS hop FROM nodes
    UNION
    SELECT w.src, e.dst, w.hop + 1 FROM walks w JOIN edges e ON e.src = w.dst WHERE w.hop < 8""",
    "nodes",
    "edges",
)
view("all_hops", "SELECT src, dst, CAST(min(hop) AS INTEGER) AS hop FROM walks GROUP BY 1, 2", "walks")
view(
    "neighbors",
    f"""SELECT h.src AS viewer, h.dst AS node_id, h.hop, n.capacity
    FROM all_hops h JOIN nodes n ON n.node_id = h.dst WHERE h.hop > 0 AND h.hop <= {MAX_HOP}""",
    "all_hops",
    "nodes",
)
view(
    "placement",
    """SELECT node_id, object_id, insert_line, slot FROM (
      SELECT node_id, object_id, insert_line, row_number() OVER (PARTITION BY node_id ORDER BY insert_line) AS slot
      FROM (SELECT node_id, object_id, min(line_no) AS insert_line FROM gets GROUP BY 1, 2))
    JOIN nodes USING (node_id) WHERE slot <= capacity""",
    "gets",
    "nodes",
)
view(
    "content",
    """SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS node_id, object_id FROM (
      SELECT source, CAST(concat('0x', substr(sha256(text), 1, 16)) AS UBIGINT) AS u,
        CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616
             ELSE CAST(u AS HUGEINT) END AS h,
        CAST(((h % 9223372036854775807) + 9223372036854775807) % 9223372036854775807 AS BIGINT) AS object_id
      FROM documents)""",
)


def over_lines(text: str) -> str:
    """A query over the same views, with requests taken from the log lines instead of the events."""
    requests = f"""SELECT line_no, CAST(NULL AS TIMESTAMP) AS ts, operation,
        CAST(((node_number % {N_NODES}) + {N_NODES}) % {N_NODES} AS INTEGER) AS node_id,
        CAST(((h % 9223372036854775807) + 9223372036854775807) % 9223372036854775807 AS BIGINT) AS object_id
      FROM (SELECT *, CAST(concat('0x', substr(sha256(object_key), 1, 16)) AS UBIGINT) AS u,
        CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE CAST(u AS HUGEINT) END AS h
      FROM ({PARSED.format(lines=f"({VIEWS['lines'][1]})")}))"""
    return text.replace(VIEWS["requests"][1], requests)


PARSED = r"""SELECT line_no, f[2] AS object_key, TRY_CAST(f[5] AS BIGINT) AS node_number, lower(f[6]) AS operation
    FROM (SELECT line_no, string_split_regex(regexp_replace(trim(value), '[,\s]+$', ''), '[,\s]+') AS f,
            trim(value) AS t FROM {lines})
    WHERE t <> '' AND NOT (line_no = 1 AND NOT regexp_matches(t, '^[0-9]')) AND len(f) >= 6
      AND regexp_matches(f[5], '^[+-]?[0-9]+$')"""


def permission_sql(source: str) -> str:
    return f"""SELECT p.node_id, p.object_id, bool_and(coalesce(c.n, 0) > 1 OR b.node_id IS NULL) AS permitted
    FROM {source} p LEFT JOIN neighbors b ON b.viewer = p.node_id
    LEFT JOIN (SELECT b2.viewer, p2.object_id, count(*) AS n FROM {source} p2 JOIN neighbors b2 USING (node_id)
               GROUP BY 1, 2) c ON c.viewer = b.node_id AND c.object_id = p.object_id
    GROUP BY 1, 2"""


view("permission", permission_sql("placement"), "placement", "neighbors")
view(
    "used",
    """SELECT n.node_id, count(p.object_id) AS used, n.capacity, count(p.object_id) / n.capacity AS utilization
    FROM nodes n LEFT JOIN placement p USING (node_id) GROUP BY n.node_id, n.capacity""",
    "nodes",
    "placement",
)
view("turns", f"SELECT node_id FROM used WHERE utilization >= {LIMIT}", "used")
view("near", "SELECT viewer, list(node_id) AS ns FROM neighbors GROUP BY 1", "neighbors")
view("all_near", "SELECT map_from_entries(list((viewer, ns))) AS m FROM near", "near")
view(
    "sweep_start",
    "SELECT object_id, list(node_id) AS alive FROM placement GROUP BY 1",
    "placement",
)


def sweep_sql(name: str, protect: str) -> str:
    """State per object after the turn of node ``s``; a drop shortens the list of copies."""
    verdict = """list_contains(alive, t) AND len(list_intersect(alive, element_at(m, t)[1])) > 0 AS candidate,
        coalesce(list_bool_and(list_transform(element_at(m, t)[1],
            lambda x: len(list_intersect(alive, element_at(m, x)[1])) > 1)), true) AS permitted"""
    return f"""SELECT object_id, -1 AS s, alive, false AS candidate, false AS permitted, false AS dropped
    FROM sweep_start
    UNION ALL
    SELECT object_id, t, CASE WHEN candidate AND permitted AND NOT viral AND turn
             THEN list_filter(alive, lambda x: x <> t) ELSE alive END,
      candidate AND turn, candidate AND permitted AND turn, candidate AND permitted AND NOT viral AND turn
    FROM (SELECT q.object_id, q.s + 1 AS t, q.alive, {verdict},
            q.object_id IN (SELECT object_id FROM {protect}) AS viral,
            (q.s + 1) IN (SELECT node_id FROM turns) AS turn
          FROM {name} q, all_near WHERE q.s < {N_NODES - 1})"""


SETTINGS = {
    "EDGE_MAX_HOP": EDGE_MAX_HOP,
    "CLOUD_HOP": CLOUD_HOP,
    "THRASH_LINES": THRASH_LINES,
}

# Hash of a 64-bit number, as arithmetic modulo 2^64.

_M = 18446744073709551616
# The five primes of the hash.
_P1 = 11400714785074694791
_P2 = 14029467366897019727
_P3 = 1609587929392839161
_P4 = 9650029242287828579
_P5 = 2870177450012600261


def _u(text: str) -> str:
    return f"CAST(({text}) AS UHUGEINT)"


def _mul(a: str, b: int) -> str:
    return f"(({a}) * {_u(str(b))} % {_u(str(_M))})"


def _rot(a: str, n: int) -> str:
    return f"((({a}) * {_u(str(1 << n))} % {_u(str(_M))}) + (({a}) // {_u(str(1 << (64 - n)))}))"


def _xor(a: str, b: str) -> str:
    return f"CAST(xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT)) AS UHUGEINT)"


def xx_steps(value: str, seed: str) -> str:
    """Columns of the steps of the hash; each reads the one before."""
    signed = f"CAST({value} AS HUGEINT)"
    steps = [
        ("x0", f"CAST(({signed} + CAST({_M} AS HUGEINT)) % CAST({_M} AS HUGEINT) AS UHUGEINT)"),
        ("x1", _mul("x0", _P2)),
        ("x2", _mul(_rot("x1", 31), _P1)),
        ("x3", _xor("x2", f"({_u(seed)} + {_u(str(_P5 + 8))}) % {_u(str(_M))}")),
        ("x4", f"(({_mul(_rot('x3', 27), _P1)}) + {_u(str(_P4))}) % {_u(str(_M))}"),
        ("x5", _xor("x4", f"x4 // {_u(str(1 << 33))}")),
        ("x6", _mul("x5", _P2)),
        ("x7", _xor("x6", f"x6 // {_u(str(1 << 29))}")),
        ("x8", _mul("x7", _P3)),
        ("x9", _xor("x8", f"x8 // {_u(str(1 << 32))}")),
    ]
    return ", ".join(f"{expr} AS {name}" for name, expr in steps)


XX_RESULT = "x9"


def signed(h: str) -> str:
    return f"""CAST(CASE WHEN {h} >= {_u(str(_M // 2))} THEN CAST({h} AS HUGEINT) - CAST({_M} AS HUGEINT)
        ELSE CAST({h} AS HUGEINT) END AS BIGINT)"""


def hashes_sql(source: str) -> str:
    return f"""SELECT object_id, {signed(XX_RESULT)} AS h FROM (
      SELECT object_id, {xx_steps('object_id', '0')} FROM (SELECT DISTINCT object_id FROM {source}))"""


def positions_sql(hashes: str, n_bits: int, n_hashes: int) -> str:
    return f"""SELECT object_id, CAST(0 AS BIGINT) AS i, abs(h % {n_bits}) AS pos FROM {hashes}
    UNION ALL
    SELECT object_id, seed AS i, abs({signed(XX_RESULT)} % {n_bits}) AS pos FROM (
      SELECT object_id, seed, {xx_steps('h', 'seed')}
      FROM {hashes}, (SELECT unnest(range(1, {n_hashes})) AS seed))"""


view("hashes", hashes_sql("content"), "content")
view("positions", positions_sql("hashes", 1 << 14, 5), "hashes")
view("place_hashes", hashes_sql("placement"), "placement")
view("place_positions", positions_sql("place_hashes", 1 << 14, 5), "place_hashes")
view(
    "negatives",
    """SELECT CAST(((h % 9223372036854775807) + 9223372036854775807) % 9223372036854775807 AS BIGINT) AS object_id FROM (
      SELECT CAST(concat('0x', substr(sha256('doc-' || doc_id), 1, 16)) AS UBIGINT) AS u,
        CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616
             ELSE CAST(u AS HUGEINT) END AS h FROM documents)""",
)
view("negative_hashes", hashes_sql("negatives"), "negatives")
view("negative_positions", positions_sql("negative_hashes", 1 << 10, 3), "negative_hashes")
view("small_negatives", "SELECT DISTINCT object_id, pos FROM negative_positions", "negative_positions")
view("small_positions", positions_sql("hashes", 1 << 10, 3), "hashes")
view("small_content", "SELECT DISTINCT node_id, pos FROM content JOIN small_positions USING (object_id)", "content", "small_positions")
view("large_negatives", f"SELECT DISTINCT object_id, pos FROM ({positions_sql('negative_hashes', 1 << 14, 5)})", "negative_hashes")
view("placed_positions", "SELECT DISTINCT node_id, pos FROM placement JOIN place_positions USING (object_id)", "placement", "place_positions")
view(
    "paths",
    """SELECT [node_id] AS path FROM nodes
    UNION ALL
    SELECT list_append(p.path, e.dst) FROM paths p JOIN edges e ON e.src = p.path[len(p.path)]
    WHERE len(p.path) < 4 AND NOT list_contains(p.path, e.dst)""",
    "nodes",
    "edges",
)
view("nobody", "SELECT object_id FROM hot WHERE false", "hot")
view("sweep", sweep_sql("sweep", "nobody"), "sweep_start", "all_near", "turns", "nobody")
view("guarded_sweep", sweep_sql("guarded_sweep", "hot"), "sweep_start", "all_near", "turns", "hot")

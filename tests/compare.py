"""Compare a query with its SQL twin, by name, rows, columns and values.

Run as a script: ``python tests/compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(sf, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(value):
    if value is None:
        return ("", "")
    if isinstance(value, float):
        return ("n", f"{value + 0.0:.9f}")
    if isinstance(value, (int, bool)):
        return ("n", f"{float(value):.9f}" if abs(value) < 2**50 else str(value))
    return ("s", str(value))


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_key(row[i]) for i in order) for row in rows)


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def differences(spark, con, name, query, oracle, sf):
    """Empty when both sides agree; else a short text."""
    df = query(spark, sf)
    got_cols, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(oracle)
    want_cols, want = table_of(relation.columns, relation.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    types = dict(df.dtypes)
    wanted = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    off = [f"{c}: {types[c]} / {wanted[c]}" for c in got_cols if SAME.get(types[c], types[c]) != wanted[c]]
    if off:
        return f"types {off}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got != want:
        pairs = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(pairs)} rows differ, first {pairs[0]}"
    if not got:
        return "no rows on either side"
    return ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from edgelake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        start = time.time()
        try:
            if name in oracle_sql():
                text = differences(spark, con, name, queries()[name], oracle_sql()[name], sf)
            else:
                text = f"(rows only: {queries()[name](spark, sf).count()})"
        except Exception as error:  # report and go on
            text = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(text) and not text.startswith("(rows")
        print(f"{'ok  ' if not text or text.startswith('(rows') else 'BAD '} {name} {time.time() - start:.1f}s {text}", flush=True)
    print(f"{bad} bad of {len(names)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

"""Compare registered queries with their SQL twins in DuckDB.

Usage: python tests/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if hasattr(value, "__float__") and not isinstance(value, int):
        return round(float(value), 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    return type(value).__name__


def compare(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return "rows-only" if got else "EMPTY", len(got), took, None
    t = time.time()
    cur = con.execute(sql)
    exp_cols, exp = rows_of([d[0] for d in cur.description], cur.fetchall())
    duck_took = time.time() - t
    if got_cols != exp_cols:
        return f"COLUMNS {got_cols} != {exp_cols}", len(got), took, duck_took
    if len(got) != len(exp):
        return f"ROWS {len(got)} != {len(exp)}: {got[:2]} {exp[:2]}", len(got), took, duck_took
    if got != exp:
        bad = [(a, b) for a, b in zip(got, exp) if a != b]
        return f"VALUES differ in {len(bad)}; {got_cols}\n   got {bad[0][0]}\n   exp {bad[0][1]}", len(got), took, duck_took
    for i, col in enumerate(got_cols):
        ka = {kind(r[i]) for r in got if r[i] is not None}
        kb = {kind(r[i]) for r in exp if r[i] is not None}
        if ka != kb:
            return f"TYPES {col}: {ka} != {kb}", len(got), took, duck_took
    return "ok" if got else "ok-EMPTY", len(got), took, duck_took


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in names:
        try:
            status, n, took, dt = compare(spark, con, sf, name, queries[name], oracles.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            status, n, took, dt = f"ERROR {str(exc)[:1500]}", 0, 0.0, None
        bad += status not in ("ok", "rows-only")
        print(f"{name:34s} {n:7d} rows {took:6.2f}s {'' if dt is None else f'duck {dt:5.2f}s'} {status}", flush=True)
    print(f"{len(names)} queries, {bad} not ok; unpaired oracles: {sorted(set(oracles) - set(queries))}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

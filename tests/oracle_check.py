"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)  # both sides round, so equal means equal
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    if hasattr(value, "is_integer") and not isinstance(value, int):
        return repr(float(value) + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "NestedLoopJoin"):
        if slow in plan:
            return -1, False, f"{slow} in the plan"
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(mine), None, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(mine), False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine == theirs:
        return len(mine), True, ""
    a, b = set(mine), set(theirs)
    return len(mine), False, f"{len(mine)} vs {len(theirs)} rows; only here {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"


def main(argv):
    from murmuration.session import local_session

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, same, note = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            n, same, note = -1, False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += same is False
        print(f"{'ok  ' if same else 'ROWS' if same is None else 'BAD '} {name:28s} {n:8d} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{len(names)} run, {bad} bad, {len(oracles)} with SQL")


if __name__ == "__main__":
    main(sys.argv[1:])

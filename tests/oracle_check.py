"""Run queries and their SQL counterparts side by side and compare whole results."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, query, sql: str, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf)
    mine = df.collect()
    took = time.time() - start
    result = con.execute(sql)
    theirs_cols = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(theirs_cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(theirs_cols)}"
    a, b = _rows(df.columns, mine), _rows(theirs_cols, theirs)
    if a == b:
        return True, f"{len(mine)} rows, {took:.1f}s"
    cols = sorted(df.columns)
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, f"{len(mine)} vs {len(theirs)} rows\n  {cols}\n  spark {only_a}\n  duck  {only_b}"


def main(names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from studyflow.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(int(os.environ.get("CORES","8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        if name not in oracle:
            print("NO SQL", name, flush=True)
            continue
        try:
            ok, text = compare(spark, con, name, queries[name], oracle[name], sf)
        except Exception as error:
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, text, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

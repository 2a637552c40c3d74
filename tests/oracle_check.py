"""Compares each query with its SQL in DuckDB: python tests/oracle_check.py [sf_dir] [name...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        p = f"{sf_dir}/{f}"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{p}'")
    return con


def cell(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def rows(names: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when the query and the SQL agree."""
    got = df.collect()
    rel = con.sql(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in got]), rows(names, rel.fetchall())
    if a == b:
        return ""
    sa, sb = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only here {sorted(sa - sb)[:3]}; only in SQL {sorted(sb - sa)[:3]}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config(
        "spark.sql.session.timeZone", "UTC"
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con, sql, bad = tables(sf), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            said = difference(f(spark, sf), con, sql[name]) if name in sql else f"no SQL, {f(spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"failed: {str(x)[:300]}"
        bad += bool(said) and name in sql or said.startswith("failed")
        print(f"{'ok  ' if not said else '    '}{name} {time.time() - t:.1f}s {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())

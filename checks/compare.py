"""Run registered queries against their SQL twins: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from . import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    mid = time.time()
    if name not in catalog.ORACLES:
        return True, f"rows-only {len(got)} rows, {mid - start:.1f}s"
    cursor = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    note = f"{len(got)}/{len(want)} rows, spark {mid - start:.1f}s, sql {time.time() - mid:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lacking = [r for r in want if r not in set(got)][:3]
        return False, f"{note}\n     spark only {extra}\n     sql only   {lacking}"
    return True, note


def main(argv: list[str]) -> int:
    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in argv[1:] or catalog.QUERIES:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

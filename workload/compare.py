"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

    python -m workload.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from .oracle import ORACLE
from .queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_session(cpus: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(v):
    return None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[int, str]:
    """Row count and a description of the first differences; empty if equal."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(_value(v) for v in row) for row in df.select(*columns).collect())
    if name not in ORACLE:
        return sum(got.values()), ""
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return sum(got.values()), f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(_value(row[i]) for i in order) for row in result.fetchall())
    kinds = lambda rows: sorted({tuple(type(v).__name__ for v in r) for r in rows if None not in r})
    if got == want:
        if kinds(got) != kinds(want):
            return sum(got.values()), f"types {kinds(got)} against {kinds(want)}"
        return sum(got.values()), ""
    extra, missing = got - want, want - got
    return sum(got.values()), f"{sum(extra.values())} extra {list(extra)[:3]}, {sum(missing.values())} missing {list(missing)[:3]} of {columns}"


def main(args: list[str]) -> int:
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark, con = spark_session(), connect(sf_dir)
    failed = 0
    for name in names:
        begin = time.time()
        try:
            rows, problem = difference(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:26} rows={rows:<8} {time.time() - begin:6.2f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))

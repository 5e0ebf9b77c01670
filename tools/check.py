"""Run registered queries next to their SQL equivalents and compare whole results.

usage: python tools/check.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def spark_session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablesteps")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        # Small test shuffles stay spread over all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


# Spark type names and the names of the same types in the other engine.
SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def compare(df, con, sql) -> tuple[str, int]:
    got_columns, got = df.columns, df.collect()
    relation = con.sql(sql)
    types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    want_columns, want = relation.columns, relation.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} / {sorted(want_columns)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}", len(got)
    for name, kind in df.dtypes:
        if SAME_TYPE.get(kind) != types[name]:
            return f"type of {name}: {kind} / {types[name]}", len(got)
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    for x, y in zip(a, b):
        if x != y:
            return f"values {str(x)[:400]} / {str(y)[:400]}", len(got)
    return "", len(got)


def main() -> int:
    from tablesteps.catalog import ORACLES, QUERIES

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:] or list(QUERIES)
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                fault, n = compare(df, con, ORACLES[name])
            else:
                fault, n = "", df.count()
        except Exception as error:  # report and go on with the next query
            fault, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += bool(fault)
        mark = "FAIL" if fault else ("ok" if name in ORACLES else "rows")
        print(f"{mark:5} {time.time() - start:6.2f}s {n:8} {name} {fault}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())

"""Run the queries against their oracle SQL: python tests/compare.py [folder] [query ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def normal(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, folder: str, name: str) -> str:
    started = time.time()
    frame = entry_point.queries()[name](spark, folder)
    ours = normal(frame.columns, frame.collect())
    seconds = time.time() - started
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(ours)} {seconds:.1f}s"
    names, rows = oracle_rows(folder, sql)
    if sorted(names) != sorted(frame.columns):
        return f"COLUMNS ours {sorted(frame.columns)} oracle {sorted(names)}"
    theirs = normal(names, rows)
    if ours != theirs:
        pair = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
        return f"DIFFER {len(ours)} / {len(theirs)} {pair}"
    return f"ok {len(ours)} {seconds:.1f}s"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry_point.queries())
    spark = session()
    for query in wanted:
        try:
            print(query, compare(spark, folder, query), flush=True)
        except Exception as problem:  # keep going, report at the end of the line
            print(query, "ERROR", str(problem)[:1500], flush=True)

"""Helpers shared by the operators: sizes, staging, column names, labelled folds."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry.operators.skew import staged, staged_rows
from inkferry.shipping import ship_package

__all__ = ["bucketed", "crc_fold", "partitions_for", "ready", "staged", "staged_rows", "table", "text_bytes"]


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers."""
    ship_package(spark)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def crc_fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def partitions_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """So many partitions that each holds about `each` bytes, and no fewer than the session's."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(n_bytes / each))


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Write a table in the warehouse, bucketed by `key` into `n` buckets of one file each.

    Wide rows are shuffled this one time; later joins on `key` move only the other, narrow side.
    """
    target = f"inkferry_{name}_{uuid.uuid4().hex}"
    (
        df.repartition(n, key)
        .write.bucketBy(n, key)
        .sortBy(key)
        .option("compression", "zstd")
        .saveAsTable(target)
    )
    return df.sparkSession.table(target)


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)

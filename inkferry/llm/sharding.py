"""Sharding by a two-pass external shuffle.

Pass one scatters the records over memory-sized buckets of their shards by seeded hashes; pass two
shuffles each bucket in memory (Fisher-Yates) and writes it. The shard follows from the key and the
number of shards alone: the shard with the greatest hash of (key, shard) gets the record, so one more
shard takes records from all others and moves none between them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkferry.llm.common import ready
from inkferry.operators.skew import checkpoint_dir

BUCKET_BYTES = 32 << 20
SEED = 20240


def shard_of(key: str, n_shards: int, seed: int = SEED) -> Column:
    hashes = F.array(*[F.xxhash64(F.col(key), F.lit(seed), F.lit(i)) for i in range(n_shards)])
    return (F.array_position(hashes, F.array_max(hashes)) - 1).cast("int")


def _fisher_yates(seed: int):
    def run(key: tuple[pa.Scalar, ...], bucket: pa.Table) -> pa.Table:
        numbers = np.random.Generator(np.random.PCG64([seed, *(k.as_py() for k in key)]))
        bucket = bucket.sort_by("_row")
        order = pa.array(numbers.permutation(len(bucket)))
        return bucket.take(order).set_column(
            bucket.column_names.index("_row"), "_row", pa.array(np.arange(len(bucket)))
        )

    return run


def write_shards(
    docs: DataFrame,
    n_shards: int,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write all rows into shards, in random order, and return the written table.

    Added columns: size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (the place in the
    shard, without gaps from 0) and grown_shard (the shard if there were one more). Files lie under
    shard=<n>; `slot` is the reading order. The default path is a new one in the shared folder.

    A null text has no bytes; a null key has a hash like any other. Rows that share a key share a shard
    but not a bucket, as records are scattered by their place in the input, so no bucket outgrows its
    size by copies. Input columns named like an added one are replaced; an empty table gives an empty
    result.
    """
    spark = ready(docs.sparkSession)
    path = path or f"{checkpoint_dir(spark)}/shards/{uuid.uuid4().hex}"
    added = ["size", "text_crc32", "shard", "slot", "grown_shard", "_bucket", "_row", "_before"]
    rows = docs.drop(*[c for c in added if c not in (key, text)])
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sized = (
        rows.withColumn("size", F.octet_length(content).cast("bigint") + 1)
        .withColumn("text_crc32", F.crc32(content.cast("binary")))
        .withColumn("shard", shard_of(key, n_shards, seed))
        .withColumn("grown_shard", shard_of(key, n_shards + 1, seed))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    total = sized.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(1, -(-total // (n_shards * bucket_bytes)))
    scattered = sized.withColumn("_bucket", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(n_buckets)))
    shuffled = scattered.groupBy("shard", "_bucket").applyInArrow(_fisher_yates(seed), scattered.schema)
    shuffled.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    written = spark.read.schema(scattered.schema).parquet(path)
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        written.groupBy("shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        written.join(starts, ["shard", "_bucket"])
        .withColumn("slot", F.col("_before") + F.col("_row"))
        .drop("_before", "_bucket", "_row")
    )

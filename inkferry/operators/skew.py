"""Joins and numbering that hold when one key owns a large part of the rows.

Adaptive skew-join only splits a join whose two sides are plain shuffles, so it does not help when
one side was aggregated on the join key. These helpers count the keys first and split the hot ones in
the logical plan instead.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 1_000_000  # of one key; a key with more rows is hot and spread over several tasks
MOST_HOT_KEYS = 100_000  # so many are split at most, which bounds what is collected and broadcast
NARROW_ROWS = 250_000  # in one file of a narrow staged table
ROW_BITS = 33  # monotonically_increasing_id: row number in the low 33 bits, partition above


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="inkferry-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that values do not change on a recompute."""
    context = df.sparkSession.sparkContext
    folder = checkpoint_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table next to the checkpoints and read it back.

    A costly step then runs once, later steps read only their columns, and a lost executor costs no
    recomputation.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_rows(df: DataFrame, n: int, name: str) -> DataFrame:
    """Stage a narrow table of about `n` rows in files of NARROW_ROWS, not one for each partition."""
    parts = max(1, -(-n // NARROW_ROWS))
    if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(parts)
    return staged(df, name)


def _hot_rows(df: DataFrame, keys: list[str]) -> list[tuple]:
    """(key columns, salts) of the hot keys, from one job over the key columns alone."""
    narrow = df.select(*keys)
    counts = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.filter(F.col("_n") > ROWS_PER_TASK).orderBy(F.desc("_n")).limit(MOST_HOT_KEYS).collect()
    total = narrow.count() if largest else 0
    return [(*r[:-1], -(-r["_n"] // ROWS_PER_TASK)) for r in largest if r["_n"] * MOST_HOT_KEYS > total]


def _hot_table(df: DataFrame, keys: list[str], rows: list[tuple]) -> DataFrame:
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField("_salts", T.LongType())]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than ROWS_PER_TASK rows, and for each the `_salts` that spread it.

    A key must also have more than one MOST_HOT_KEYS-th of all rows, so fewer than that can qualify: the
    list is safe to collect and to broadcast whatever the input's size. It is counted while the plan is
    built, by partial aggregation; it only steers how rows are spread, never the result.
    """
    return _hot_table(df, keys, _hot_rows(df, keys))


def _tagged(df: DataFrame, keys: list[str], hot: list[tuple]) -> DataFrame:
    """The rows with the `_salts` of their key, NULL if it is not hot; a NULL key can be hot too."""
    same_key = [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    table = F.broadcast(_hot_table(df, keys, hot)).alias("h")
    return df.alias("l").join(table, same_key, "left").select("l.*", "h._salts")


def skew_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: str
) -> DataFrame:
    """Join a left side that may be hot on `keys` to a right side with few rows per key.

    Left rows of a hot key are spread over its salts by hashing `spread_by`, and only the right rows of
    hot keys are repeated, once per salt. A hot NULL key matches nothing and is just spread. Without a
    hot key it is a plain join.
    """
    hot = _hot_rows(left, keys)
    if not hot:
        return left.join(right, keys, how)
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by), F.col("_salts")))
    salted_left = _tagged(left, keys, hot).withColumn("_salt", salt).drop("_salts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts") - 1, F.lit(0)))
    salted_right = _tagged(right, keys, hot).withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def number_within(
    df: DataFrame, keys: list[str], order: list[str], out: str, block: Column
) -> DataFrame:
    """Number rows 1, 2, ... (BIGINT) within `keys` by `order`, with no task per hot key.

    `block` must rise with `order` and hold a bounded number of rows per value (such as
    `id div 100000`). Rows of a hot key are numbered block by block and shifted by the size of the
    blocks before; the rows of any other key are one block.
    """
    hot = _hot_rows(df, keys)
    if not hot:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, place.cast("bigint"))
    tagged = _tagged(df, keys, hot).withColumn(
        "_block", F.when(F.col("_salts").isNotNull(), block).otherwise(F.lit(0)).cast("bigint")
    )
    by_block = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        tagged.filter("_salts IS NOT NULL")
        .groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*keys, "_block", F.sum("_size").over(before).alias("_shift"))
    )
    same_block = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_block")]
    number = (F.col("_local") + F.coalesce("_shift", F.lit(0))).cast("bigint")
    return (
        tagged.withColumn("_local", F.row_number().over(by_block))
        .alias("l")
        .join(shifts.alias("s"), same_block, "left")
        .select("l.*", "s._shift")
        .withColumn(out, number)
        .drop("_salts", "_block", "_local", "_shift")
    )


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows 1, 2, ... by `order`, which must end in a unique column.

    Range partitions are sorted in parallel and frozen by a checkpoint; each row number is its place
    in the partition plus the size of the partitions before. The offsets have one row per partition.
    """
    frozen = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", ROW_BITS)
    place = F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    parted = frozen.select("*", part.alias("_part"), place.alias("_place")).drop("_slot")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.sum("_size").over(before).alias("_shift"))
    )
    return (
        parted.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_place") + F.coalesce("_shift", F.lit(0)) + 1)
        .drop("_part", "_place", "_shift")
    )


def number_sorted_within(
    df: DataFrame, keys: list[str], order: list[str], out: str, spread_by: str
) -> DataFrame:
    """Like `number_within` for an order that has no numeric blocks, such as sorted text."""
    ranked = number_rows(df, [*keys, *order], "_rank")
    starts = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return (
        skew_join(ranked, starts, keys, "inner", spread_by)
        .withColumn(out, F.col("_rank") - F.col("_first") + 1)
        .drop("_rank", "_first")
    )

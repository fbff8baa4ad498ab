"""Rate usage of closed intervals: each is reported once, when the watermark passes its end, and later
rows become corrections instead of being dropped.

The watermark is the newest start seen in any batch less the allowed delay. It is taken from the batches
themselves, so a replay closes the same intervals again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry.streaming import tiers
from inkferry.streaming.streams import interval_starts, merged_starts

USAGE = "blog_url STRING, interval_start TIMESTAMP, starts BIGINT"


def _newest(clock: DataFrame) -> DataFrame:
    return clock.agg(F.max("newest").alias("newest"))


def _closed(interval: str, watermark: int | None) -> Column:
    """Has the watermark passed the end of the interval?"""
    if watermark is None:
        return F.lit(False)
    end = F.col("interval_start") + F.expr(f"INTERVAL '{interval}'")
    return end <= F.timestamp_micros(F.lit(watermark))


def _watermark(clock: DataFrame, delay: str) -> int | None:
    """Microseconds since 1970."""
    newest = F.max("newest") - F.expr(f"INTERVAL '{delay}'")
    return clock.agg(F.unix_micros(newest).alias("w")).first().w


def run_closed_intervals(
    stream: DataFrame, interval: str, delay: str, path: str, checkpoint: str
) -> None:
    """Process all starts(blog_url, started_at) available; see `closed`, `corrections` and `still_open`.

    A start without a time belongs to no interval and is not counted, as in the batch form.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        counts = tiers.put(interval_starts(batch, interval), f"{path}/starts", batch_id, merged_starts)
        seen = batch.agg(F.max("started_at").alias("newest"))
        clock = tiers.put(seen, f"{path}/clock", batch_id, _newest)
        clock_before = tiers.before(clock, f"{path}/clock", batch_id, _newest)
        passed = _closed(interval, _watermark(clock_before, delay))
        passes = _closed(interval, _watermark(clock_before.unionByName(clock), delay))
        earlier = tiers.before(counts, f"{path}/starts", batch_id, merged_starts)
        late = counts.filter(passed)
        closing = merged_starts(earlier.unionByName(counts)).filter(passes & ~passed)
        late.write.mode("overwrite").parquet(f"{path}/corrections/batch_id={batch_id}")
        closing.write.mode("overwrite").parquet(f"{path}/closed/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def closed(spark: SparkSession, path: str) -> DataFrame:
    """(blog_url, interval_start, starts, batch_id): every closed interval once."""
    return spark.read.schema(f"{USAGE}, batch_id BIGINT").parquet(f"{path}/closed")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """Starts that came after their interval was closed, to be added to it."""
    return spark.read.schema(f"{USAGE}, batch_id BIGINT").parquet(f"{path}/corrections")


def still_open(spark: SparkSession, path: str, interval: str, delay: str, n_batches: int) -> DataFrame:
    """Counts so far of the intervals that the watermark has not passed."""
    clock = tiers.before(spark.createDataFrame([], "newest TIMESTAMP"), f"{path}/clock", n_batches, _newest)
    counts = tiers.before(spark.createDataFrame([], USAGE), f"{path}/starts", n_batches, merged_starts)
    return counts.filter(~_closed(interval, _watermark(clock, delay)))

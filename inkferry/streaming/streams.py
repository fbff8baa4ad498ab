"""The history and the parsed posts kept up to date from streams.

Each micro-batch is aggregated by itself and kept as one folder of partial results; writing a batch
again replaces it. Partial results merge by sums, maxima and newest values, so the stream holds no state
in memory, however many keys there are, and a row counts however late it comes. `compact` folds the
folders of finished batches into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry.config import MigrationConfig
from inkferry.functions.text import resolve_url
from inkferry.operators.extract import parse_posts, parse_stage
from inkferry.operators.history import items_of_blogs

Merge = Callable[[DataFrame], DataFrame]


def item_state(patches: DataFrame) -> DataFrame:
    """Latest value of each patched field per item, from patches `(id, seq, field, value)`.

    One row per (id, field); `seq` tells how new it is. Merges its own results too.
    """
    newest = F.max_by(F.struct("value"), "seq")["value"]
    return patches.groupBy("id", "field").agg(newest.alias("value"), F.max("seq").alias("seq"))


def retry_counts(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Completion and failure counts per post; see `due_for_retry`."""
    return (
        items_of_blogs(items, jobs)
        .groupBy("blog_url", "post_url")
        .agg(
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )


def merged_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("blog_url", "post_url").agg(
        F.sum("completed").alias("completed"), F.sum("failed").alias("failed")
    )


def due_for_retry(state: DataFrame) -> DataFrame:
    return state.filter((F.col("completed") == 0) & (F.col("failed") > 0)).select("blog_url", "post_url")


def listed_urls(list_pages: DataFrame, cfg: MigrationConfig = MigrationConfig()) -> DataFrame:
    """Distinct posts on list pages, also behind the end of a blog; merges by `distinct`.

    `frontier` keeps to the pages up to the first missing or empty one.
    """
    links = parse_stage(list_pages, cfg, ("list_links",), ("blog_url",)).select(
        "blog_url", F.explode("hrefs").alias("href")
    )
    address = resolve_url(F.col("blog_url"), F.col("href"), cfg.protocol_relative)
    return links.select("blog_url", address.alias("post_url")).distinct()


def new_urls(listed: DataFrame, attempted: DataFrame) -> DataFrame:
    """Listed posts that were never attempted, each once, on whatever page they are."""
    key = ["blog_url", "post_url"]
    return listed.select(*key).distinct().join(attempted.select(*key), key, "left_anti")


def interval_starts(starts: DataFrame, interval: str) -> DataFrame:
    """Starts per blog and interval; `starts(blog_url, started_at)`."""
    return (
        starts.groupBy("blog_url", F.window("started_at", interval).alias("w"))
        .agg(F.count(F.lit(1)).alias("starts"))
        .select("blog_url", F.col("w.start").alias("interval_start"), "starts")
    )


def merged_starts(starts: DataFrame) -> DataFrame:
    return starts.groupBy("blog_url", "interval_start").agg(F.sum("starts").alias("starts"))


def against_cap(starts: DataFrame, cap: int) -> DataFrame:
    return starts.withColumn("over_cap", F.col("starts") > cap)


def rate_usage(starts: DataFrame, interval: str, cap: int) -> DataFrame:
    """Starts per blog and interval against the cap."""
    return against_cap(interval_starts(starts, interval), cap)


def stream_parse(pages: DataFrame, cfg: MigrationConfig = MigrationConfig(), keep: tuple[str, ...] = ("blog_url", "url")) -> DataFrame:
    """Arriving pages as parsed posts."""
    return parse_posts(pages, cfg, keep=keep)


# --- running and reading ---


def run_partials(stream: DataFrame, of_batch: Merge, path: str, checkpoint: str) -> None:
    """Process all that is available and keep the partial result of each batch under `path`."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        of_batch(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_appends(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is available into parquet files under `path`."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def merged(spark: SparkSession, paths: list[str], merge: Merge) -> DataFrame:
    """The current result from all partial results under `paths`."""
    parts = [spark.read.parquet(path) for path in paths]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return merge(table)


def compact(spark: SparkSession, path: str, merge: Merge, target: str) -> str:
    """Fold the partial results under `path` into one new folder of `target`, and return it.

    Later streams write to a fresh path, which is read together with the compacted folder; the old path
    can then be removed.
    """
    folder = f"{target}/compacted-{uuid.uuid4().hex}"
    merged(spark, [path], merge).write.parquet(folder)
    return folder

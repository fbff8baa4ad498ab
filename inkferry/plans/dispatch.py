"""What to start when: rate-limited dispatch and retry delays, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.operators.history import url_states
from inkferry.operators.skew import number_sorted_within, number_within


def dispatch_plan(
    urls: DataFrame,
    cap: int,
    interval_ms: int,
    workers: int,
    order: list[str],
    block: Column | None = None,
) -> DataFrame:
    """Start slot and worker lane of every post: at most `cap` starts per interval and blog.

    `order` is the queue order within a blog. With a numeric order, `block` (see `number_within`)
    numbers the queue without a full sort.
    """
    if min(cap, interval_ms, workers) < 1:
        raise ValueError("cap, interval_ms and workers must be at least 1")
    if block is not None:
        queue = number_within(urls, ["blog_url"], order, "n", block)
    else:
        queue = number_sorted_within(urls, ["blog_url"], order, "n", spread_by=order[-1])
    before = F.col("n") - 1
    slot = F.floor(before / cap)
    return queue.select(
        "blog_url",
        "post_url",
        F.col("n").cast("bigint").alias("n"),
        slot.alias("slot"),
        (slot * interval_ms).alias("start_ms"),
        (before % workers).cast("bigint").alias("lane"),
    )


def failed_attempts(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Posts that are due for another try, with the number of failures so far."""
    return (
        url_states(items, jobs)
        .filter((F.col("completed") == 0) & (F.col("failed") > 0))
        .select("blog_url", "post_url", F.col("failed").alias("n"))
    )


def retry_plan(
    attempts: DataFrame, max_attempts: int, initial_ms: int, max_ms: int, multiplier: float
) -> DataFrame:
    """Delay before the next try after `n` failures; the last allowed attempt has no next one.

    The first delay is not capped, later ones grow by `multiplier` up to `max_ms`.
    """
    if max_attempts <= 0:
        raise ValueError("max_attempts must be greater than 0")
    later = F.least(initial_ms * F.pow(F.lit(float(multiplier)), F.col("n") - 1), F.lit(float(max_ms)))
    delay = F.when(F.col("n") == 1, F.lit(initial_ms)).otherwise(later.cast("bigint"))
    exhausted = F.col("n") >= max_attempts
    return attempts.select(
        "blog_url",
        "post_url",
        "n",
        exhausted.alias("exhausted"),
        F.when(~exhausted, delay.cast("bigint")).alias("delay_ms"),
    )

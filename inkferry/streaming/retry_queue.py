"""A retry queue that comes due by itself: failures go in, timers let posts out when their delay is over.

Per post the state is its last event: how often it failed, and when it is due or how it ended. A failure
sets the post's timer by the delays of `plans.dispatch.retry_plan`; when the newest attempt, less the
delay of the stream, passes the timer, the post is sent out; the last allowed failure takes it out for
good, and so does a completion. Each batch settles all its posts in one window over the last events and
the new attempts. The last events are kept in tiers beside the checkpoint, so running a batch again
changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkferry.streaming import tiers

POST = ["blog_url", "post_url"]
QUEUED, SENT, EXHAUSTED, DONE = "queued", "sent", "exhausted", "completed"
OUTPUT = "blog_url STRING, post_url STRING, n BIGINT, event STRING, delay_ms BIGINT, due_at TIMESTAMP, step BIGINT"
NEWEST = "newest TIMESTAMP"


def delay_after(n: int, initial_ms: int, max_ms: int, multiplier: float) -> int:
    """Delay after the n-th failure; the first one is not capped."""
    return initial_ms if n == 1 else int(min(initial_ms * float(multiplier) ** (n - 1), float(max_ms)))


def _latest(events: DataFrame) -> DataFrame:
    """The last event of every post; merges its own results too."""
    last = F.max_by(F.struct("n", "event", "delay_ms", "due_at", "step"), "step").alias("last")
    return events.groupBy(*POST).agg(last).select(*POST, "last.*")


def _newest(times: DataFrame) -> DataFrame:
    return times.agg(F.max("newest").alias("newest"))


class RetryQueue:
    def __init__(self, max_attempts: int, initial_ms: int, max_ms: int, multiplier: float):
        if max_attempts <= 0:
            raise ValueError("max_attempts must be greater than 0")
        self.max_attempts, self.delays = max_attempts, (initial_ms, max_ms, multiplier)

    def _delay(self, n: Column) -> Column:
        """`delay_after` as a column."""
        initial_ms, max_ms, multiplier = self.delays
        later = F.least(initial_ms * F.pow(F.lit(float(multiplier)), n - 1), F.lit(float(max_ms)))
        return F.when(n == 1, F.lit(initial_ms)).otherwise(later.cast("bigint")).cast("bigint")

    def events(self, last: DataFrame, attempts: DataFrame, watermark_ms: int | None) -> DataFrame:
        """What happens to the posts of `last`, their last events so far, when `attempts` arrive and then the
        watermark stands at `watermark_ms`. A failure without a time counts, but has no timer."""
        old = last.select(
            *POST,
            F.lit(True).alias("old"),
            F.lit(None).cast("bigint").alias("id"),
            F.lit(None).cast("bigint").alias("at_ms"),
            F.col("n").alias("failures"),
            (F.col("event") == DONE).alias("done"),
            F.when(F.col("event") == QUEUED, F.unix_millis("due_at")).alias("old_due"),
        )
        failed = F.col("status") == "failed"
        new = attempts.filter(failed | (F.col("status") == "completed")).select(
            *POST,
            F.lit(False).alias("old"),
            F.col("id").cast("bigint").alias("id"),
            F.unix_millis("at").alias("at_ms"),
            failed.cast("bigint").alias("failures"),
            (~failed).alias("done"),
            F.lit(None).cast("bigint").alias("old_due"),
        )
        order = [F.desc("old"), F.asc_nulls_last("at_ms"), F.asc_nulls_last("id"), F.asc("done")]
        post = Window.partitionBy(*POST).orderBy(*order)
        so_far = post.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        settled = old.unionByName(new).select(
            *POST,
            "old",
            "at_ms",
            "done",
            "old_due",
            F.sum("failures").over(so_far).alias("n"),
            F.count_if("done").over(so_far).alias("ends"),
            F.lead(F.lit(True), 1, False).over(post).alias("more"),
            F.lead("at_ms").over(post).alias("next_ms"),
        )
        # nothing counts after the first completion
        open_ = settled.filter((F.col("ends") == 0) | ((F.col("ends") == 1) & F.col("done")))
        delay, over = self._delay(F.col("n")), F.col("n") >= self.max_attempts
        due_ms = F.when(F.col("old"), F.col("old_due")).when(~F.col("done") & ~over, F.col("at_ms") + delay)
        timed = open_.withColumn("due_ms", due_ms)
        end = F.when(F.col("more"), F.col("next_ms")).otherwise(F.lit(watermark_ms).cast("bigint"))
        due_at = F.timestamp_millis("due_ms")

        def event(name: str, step: Column, timer: bool) -> Column:
            return F.struct(
                F.col("n").alias("n"),
                F.lit(name).alias("event"),
                (delay if timer else F.lit(None).cast("bigint")).alias("delay_ms"),
                (due_at if timer else F.lit(None).cast("timestamp")).alias("due_at"),
                step.alias("step"),  # orders the rows of one post, whatever batch they come from
            )

        done = event(DONE, F.lit((1 << 40) + 2), False)
        exhausted, queued = event(EXHAUSTED, 4 * F.col("n") + 1, False), event(QUEUED, 4 * F.col("n"), True)
        own = F.when(~F.col("old"), F.when(F.col("done"), done).when(over, exhausted).otherwise(queued))
        sent = F.when(F.col("due_ms") <= end, event(SENT, 4 * F.col("n") + 1, True))
        each = F.explode(F.filter(F.array(own, sent), lambda e: e.isNotNull())).alias("e")
        return timed.select(*POST, each).select(*POST, "e.*")


@dataclass(frozen=True)
class Queue:
    """Attempts to come, the rules for them, and how far the log can lag."""

    attempts: DataFrame
    rules: RetryQueue
    delay: str


def retry_queue(
    attempts: DataFrame,
    max_attempts: int,
    initial_ms: int,
    max_ms: int,
    multiplier: float,
    delay: str = "0 seconds",
) -> Queue:
    """The queue over a stream of attempts(id, blog_url, post_url, status, at), `at` a timestamp.

    One row per event of a post: `queued`, `sent`, `exhausted` or `completed`. They follow from the times
    of the attempts, however these fall into batches. Attempts that come later than `delay` behind the
    newest one of the batches before are too late for a timer and left out, so choose it as long as the
    log can lag. Rows of one batch are taken by time, then id.
    """
    narrow = attempts.select("id", *POST, "status", "at")
    return Queue(narrow, RetryQueue(max_attempts, initial_ms, max_ms, multiplier), delay)


def run_retry_queue(queue: Queue, path: str, checkpoint: str) -> None:
    """Process all attempts available; the events go to parquet files under `path`, a folder for each batch."""

    def watermark(times: DataFrame) -> int | None:
        newest = F.col("newest") - F.expr(f"INTERVAL '{queue.delay}'")
        return _newest(times).select(F.unix_millis(newest)).first()[0]

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark, seen, posts = batch.sparkSession, f"{checkpoint}/newest", f"{checkpoint}/posts"
        times = tiers.before(spark.createDataFrame([], NEWEST), seen, batch_id, _newest)
        closed_ms = watermark(times)
        now = tiers.put(batch.agg(F.max("at").alias("newest")), seen, batch_id, _newest)
        if closed_ms is not None:
            late = F.col("at") <= F.timestamp_millis(F.lit(closed_ms))
            batch = batch.filter(~F.coalesce(late, F.lit(False)))
        last = tiers.before(spark.createDataFrame([], OUTPUT), posts, batch_id, _latest)
        found = queue.rules.events(last, batch, watermark(times.unionByName(now)))
        out = f"{path}/batch_id={batch_id}"
        found.write.mode("overwrite").parquet(out)
        tiers.put(_latest(spark.read.schema(OUTPUT).parquet(out)), posts, batch_id, _latest)

    (
        queue.attempts.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def queue_state(spark: SparkSession, path: str) -> DataFrame:
    """The last event of every post that is not completed: still queued, sent or exhausted."""
    events = spark.read.schema(OUTPUT).parquet(path)
    return _latest(events).drop("step").filter(F.col("event") != DONE)

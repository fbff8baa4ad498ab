"""Questions about the migration history (jobs, items, assets, map, links).

Every function covers all blogs at once; `blog_url` narrows it to one. Results carry no order: the
writers in `sources.exports` sort. Items are attempts, so one post may have many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.operators.skew import number_within, skew_join, staged

BLOCK_ROWS = 100_000
JOB_FAILED_MESSAGE = "Some items failed to migrate"

# How failure messages are told apart, first match wins.
CAUSES = (
    ("timeout", r"(?i)timeout|timed out|ETIMEDOUT"),
    ("rate limited", r"\b429\b"),
    ("server error", r"\b5\d\d\b"),
    ("client error", r"\b4\d\d\b"),
    ("network", r"(?i)ECONN|ENOTFOUND|network|socket"),
    ("invalid data", r"(?i)invalid|unexpected"),
)


def _completed() -> Column:
    return F.col("status") == "completed"


def _failed() -> Column:
    return F.col("status") == "failed"


def items_of_blogs(items: DataFrame, jobs: DataFrame, blog_url: str | None = None) -> DataFrame:
    """Items with the blog of their job.

    No hint: Spark broadcasts the jobs when they are below its threshold, and otherwise both sides
    are plain shuffles, where adaptive execution splits a job that owns many items.
    """
    if blog_url is not None:
        jobs = jobs.filter(F.col("blog_url") == blog_url)
    return items.join(jobs.select(F.col("id").alias("job_id"), "blog_url"), "job_id")


def url_states(items: DataFrame, jobs: DataFrame, blog_url: str | None = None) -> DataFrame:
    """Attempts, completions and failures per post; one partially aggregated pass."""
    return (
        items_of_blogs(items.select("job_id", "post_url", "status"), jobs, blog_url)
        .groupBy("blog_url", "post_url")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count_if(_completed()).alias("completed"),
            F.count_if(_failed()).alias("failed"),
        )
    )


def attempted_urls(items: DataFrame, jobs: DataFrame, blog_url: str | None = None) -> DataFrame:
    """Posts with any item, whatever its state."""
    return (
        items_of_blogs(items.select("job_id", "post_url"), jobs, blog_url)
        .select("blog_url", "post_url")
        .distinct()
    )


def pending_urls(discovered: DataFrame, items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Discovered posts that were never attempted; `discovered` has one row per post."""
    return discovered.join(attempted_urls(items, jobs), ["blog_url", "post_url"], "left_anti")


def retry_urls(items: DataFrame, jobs: DataFrame, blog_url: str | None = None) -> DataFrame:
    """Posts that failed at least once and never completed."""
    return (
        url_states(items, jobs, blog_url)
        .filter((F.col("completed") == 0) & (F.col("failed") > 0))
        .select("blog_url", "post_url")
    )


def stuck_urls(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Posts that were attempted but neither failed nor completed: no run picks them up again."""
    return (
        url_states(items, jobs)
        .filter((F.col("completed") == 0) & (F.col("failed") == 0))
        .select("blog_url", "post_url")
    )


def unresolved_failures(
    items: DataFrame, jobs: DataFrame, blog_url: str | None = None
) -> DataFrame:
    """Failed items of posts that never completed on the same blog."""
    tagged = items_of_blogs(items, jobs, blog_url)
    done = (
        tagged.filter(_completed()).select("blog_url", "post_url").distinct()
    )
    return skew_join(
        tagged.filter(_failed()), done, ["blog_url", "post_url"], "left_anti", spread_by="id"
    )


def failed_posts_report(
    items: DataFrame, jobs: DataFrame, blog_url: str | None = None
) -> DataFrame:
    """Per unresolved post its distinct non-empty messages, numbered in the order they first came up.

    One row per message, so that no row or task holds all messages of a post; a post without any has
    one row with `n` 0 and no message. `first_id` is the post's first failure.
    """
    post = ["blog_url", "post_url"]
    failures = unresolved_failures(items, jobs, blog_url)
    messages = staged(
        failures.groupBy(*post, "error_message").agg(F.min("id").alias("seen_id")), "messages"
    )
    first = messages.groupBy(*post).agg(F.min("seen_id").alias("first_id"))
    worded = messages.filter(F.coalesce("error_message", F.lit("")) != "")
    numbered = number_within(
        worded, post, ["seen_id"], "n", block=F.floor(F.col("seen_id") / BLOCK_ROWS)
    )
    with_first = skew_join(numbered, first, post, "inner", spread_by="seen_id")
    wordless = first.join(worded.select(*post).distinct(), post, "left_anti")
    return with_first.select(*post, "first_id", "n", "error_message").unionByName(
        wordless.select(
            *post,
            "first_id",
            F.lit(0).cast("bigint").alias("n"),
            F.lit(None).cast("string").alias("error_message"),
        )
    )


def skipped_of_jobs(skipped: DataFrame, jobs: DataFrame) -> DataFrame:
    """Skipped posts of a blog, from planning, as those of its newest running full job."""
    running = latest_running_job(jobs).filter("job_type = 'full'")
    return skipped.join(running.select("blog_url", F.col("id").alias("job_id")), "blog_url").select(
        "job_id", "skipped"
    )


def job_summary(jobs: DataFrame, items: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Counts per job; jobs without items count 0. `skipped(job_id, skipped)` comes from planning."""
    counts = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("detected"),
        F.count_if(_completed()).alias("completed"),
        F.count_if(_failed()).alias("failed"),
    )
    joined = jobs.select(F.col("id").alias("job_id"), "blog_url", "job_type").join(
        counts, "job_id", "left"
    )
    if skipped is not None:
        joined = joined.join(skipped, "job_id", "left")
    else:
        joined = joined.withColumn("skipped", F.lit(0).cast("bigint"))
    zeroed = joined.fillna(0, ["detected", "completed", "failed", "skipped"])
    return zeroed.withColumn("processed", F.col("completed") + F.col("failed"))


def finalize_jobs(jobs: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Closing state of every job; items that still run do not matter."""
    broken = F.col("failed") > 0
    return job_summary(jobs, items).select(
        "job_id",
        F.when(broken, "failed").otherwise("completed").alias("status"),
        F.when(broken, JOB_FAILED_MESSAGE).alias("error_message"),
        now.alias("completed_at"),
        broken.cast("int").alias("exit_code"),
    )


def latest_running_job(jobs: DataFrame) -> DataFrame:
    """Newest running job per type and blog."""
    return (
        jobs.filter(F.col("status") == "running")
        .groupBy("job_type", "blog_url")
        .agg(F.max_by(F.struct(*[c for c in jobs.columns if c not in ("job_type", "blog_url")]), "id").alias("job"))
        .select("job_type", "blog_url", "job.*")
    )


def items_by_job(
    items: DataFrame, job_id: int | None = None, status: str | None = None
) -> DataFrame:
    if job_id is not None:
        items = items.filter(F.col("job_id") == job_id)
    return items if status is None else items.filter(F.col("status") == status)


def by_id(table: DataFrame, row_id: int) -> DataFrame:
    """One job, item or other history row."""
    return table.filter(F.col("id") == row_id)


def links_by_job(links: DataFrame, items: DataFrame, job_id: int | None = None) -> DataFrame:
    """Links with the job of their item. Plain shuffles on both sides, so skew is split adaptively."""
    chosen = items_by_job(items, job_id).select(F.col("id").alias("job_item_id"), "job_id")
    return links.join(chosen, "job_item_id")


def links_by_item(links: DataFrame, item_id: int) -> DataFrame:
    return links.filter(F.col("job_item_id") == item_id)


def images_by_item(assets: DataFrame, item_id: int | None = None) -> DataFrame:
    return assets if item_id is None else assets.filter(F.col("job_item_id") == item_id)


def map_lookup(post_map: DataFrame, urls: DataFrame) -> DataFrame:
    """The destination post of every asked address, NULL when there is none."""
    return urls.select("post_url").distinct().join(
        post_map.select("post_url", F.col("id").alias("map_id"), "dest_post_id"), "post_url", "left"
    )


def attempt_numbers(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each item's place among the attempts of its post."""
    return number_within(
        items_of_blogs(items, jobs).select("id", "blog_url", "post_url", "status"),
        ["blog_url", "post_url"],
        ["id"],
        "attempt",
        block=F.floor(F.col("id") / BLOCK_ROWS),
    )


def resolve_links(links: DataFrame, post_map: DataFrame) -> DataFrame:
    """Internal links with their target's destination post; links without one are dangling.

    Many links may lead to the same page, so the join is salted.
    """
    targets = post_map.select(F.col("post_url").alias("target_url"), "dest_post_id")
    return skew_join(links, targets, ["target_url"], "left", spread_by="id").withColumn(
        "dangling", F.col("dest_post_id").isNull()
    )


def failure_causes(items: DataFrame) -> DataFrame:
    """Failed items per kind of cause."""
    message = F.coalesce("error_message", F.lit(""))
    cause = F.when(message == "", "none given")
    for name, pattern in CAUSES:
        cause = cause.when(message.rlike(pattern), name)
    return (
        items.filter(_failed())
        .groupBy(cause.otherwise("other").alias("cause"))
        .agg(F.count(F.lit(1)).alias("items"))
    )

"""The runs as compositions of the operators: what a full, retry or single run has to do.

Uploading happens elsewhere. Its outcomes come back as patch rows (`ledger.apply_patches`), after
which `history.job_summary` and `history.finalize_jobs` close the job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkferry.config import MigrationConfig
from inkferry.operators import content, extract, history, previews
from inkferry.operators.skew import staged
from inkferry.plans import dispatch

Stage = Callable[[DataFrame], DataFrame]


def run_stages(pages: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Pass pages through the stages in order; any stage may be replaced by the caller."""
    for stage in stages:
        pages = pages.transform(stage)
    return pages


def post_stages(cfg: MigrationConfig, fetched_pages: DataFrame) -> list[Stage]:
    """Parse, then put in the preview cards. Cards come before links and images are listed."""

    def parse(pages: DataFrame) -> DataFrame:
        return staged(extract.parse_posts(pages, cfg), "posts")

    def cards(posts: DataFrame) -> DataFrame:
        shown = previews.preview_metadata(extract.bookmarks(posts), fetched_pages)
        return content.replace_bookmarks(posts, staged(shown, "previews"))

    return [parse, cards]


def assemble_posts(pages: DataFrame, fetched_pages: DataFrame, cfg: MigrationConfig) -> DataFrame:
    """Posts as they are before anything is uploaded."""
    return run_stages(pages, post_stages(cfg, fetched_pages))


def finished_content(posts: DataFrame) -> DataFrame:
    return posts.withColumn("content", content.joined(F.col("segments")))


def plan_full_run(
    list_pages: DataFrame, items: DataFrame, jobs: DataFrame, cfg: MigrationConfig
) -> tuple[DataFrame, DataFrame]:
    """Dispatch plan of the posts never attempted, and how many were skipped per blog."""
    found = staged(extract.discover_post_urls(list_pages, cfg), "discovered")
    pending = staged(history.pending_urls(found, items, jobs), "pending")
    counts = found.groupBy("blog_url").agg(F.count(F.lit(1)).alias("found"))
    open_counts = pending.groupBy("blog_url").agg(F.count(F.lit(1)).alias("open"))
    skipped = counts.join(open_counts, "blog_url", "left").select(
        "blog_url", (F.col("found") - F.coalesce("open", F.lit(0))).alias("skipped")
    )
    plan = dispatch.dispatch_plan(
        pending,
        cfg.rate_cap,
        cfg.rate_interval_ms,
        cfg.workers,
        ["page_no", "pos"],
        block=F.floor(F.col("page_no") / extract.PAGES_PER_BLOCK),
    )
    return plan, skipped


def plan_retry_run(items: DataFrame, jobs: DataFrame, cfg: MigrationConfig) -> DataFrame:
    """Dispatch plan of the posts that failed and never completed, by address."""
    return dispatch.dispatch_plan(
        history.retry_urls(items, jobs), cfg.rate_cap, cfg.rate_interval_ms, cfg.workers, ["post_url"]
    )


def pages_to_run(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """The pages of the planned posts."""
    return pages.join(plan.select(F.col("post_url").alias("url")), "url", "left_semi")

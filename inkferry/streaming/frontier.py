"""New posts from a running crawl, with the end of each blog respected.

List pages arrive in any order. A blog is read up to its first page that is missing or empty so far, so
posts on pages behind a gap are held back until the gap is filled. The pages seen are kept as bitmaps of
32,768 pages, which merge by OR, and the posts with the place where each is seen first, which merge by
minimum; no task ever holds a whole blog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry.config import MigrationConfig
from inkferry.functions.text import resolve_url
from inkferry.operators.extract import parse_stage
from inkferry.operators.skew import skew_join, staged
from inkferry.streaming import tiers

BITMAP_PAGES = 32_768  # fixed by bitmap_construct_agg


def listed_pages(list_pages: DataFrame, cfg: MigrationConfig = MigrationConfig()) -> DataFrame:
    """(blog_url, page_no, hrefs) of list pages; pages are numbered from 1."""
    parsed = parse_stage(list_pages, cfg, ("list_links",), ("blog_url", "page_no"))
    hrefs = F.coalesce("hrefs", F.array().cast("array<string>")).alias("hrefs")
    return parsed.filter("page_no >= 1").select("blog_url", F.col("page_no").cast("bigint").alias("page_no"), hrefs)


def page_marks(parsed: DataFrame) -> DataFrame:
    """(blog_url, bucket, pages): bitmaps of the pages that list posts."""
    return (
        parsed.filter(F.size("hrefs") > 0)
        .groupBy("blog_url", F.bitmap_bucket_number("page_no").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("page_no")).alias("pages"))
    )


def merged_marks(marks: DataFrame) -> DataFrame:
    return marks.groupBy("blog_url", "bucket").agg(F.bitmap_or_agg("pages").alias("pages"))


def blog_ends(marks: DataFrame) -> DataFrame:
    """(blog_url, end): the first page that is missing or empty, from merged marks.

    A blog without any page that lists posts has no row. Every bitmap also asks for the first one and for
    its successor, so a bitmap that is not there counts as empty.
    """
    digits = F.hex("pages")
    whole = F.floor(F.length(F.regexp_extract(digits, "^(?:FF)*", 0)) / 2)  # leading bytes that are full
    byte = F.conv(F.substr(digits, (2 * whole + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    ones = F.bit_count(byte.bitwiseXOR(byte + 1)) - 1  # its low bits up to the first zero
    first_zero = F.when(F.bitmap_count("pages") < BITMAP_PAGES, 8 * whole + ones)
    none = F.lit(0).cast("bigint")
    mark = lambda bucket, free: F.struct(bucket.alias("bucket"), free.alias("free"))
    asked = F.array(
        mark(F.col("bucket"), F.coalesce(first_zero, F.lit(BITMAP_PAGES)).cast("bigint")),
        mark(F.col("bucket") + 1, none),
        mark(F.lit(1).cast("bigint"), none),
    )
    page = (F.col("bucket") - 1) * BITMAP_PAGES + F.col("free") + 1
    return (
        marks.select("blog_url", F.explode(asked).alias("m"))
        .groupBy("blog_url", "m.bucket")
        .agg(F.max("m.free").alias("free"))
        .filter(F.col("free") < BITMAP_PAGES)
        .groupBy("blog_url")
        .agg(F.min(page).alias("end"))
    )


def first_places(parsed: DataFrame, cfg: MigrationConfig = MigrationConfig()) -> DataFrame:
    """(blog_url, post_url, page_no, pos) where each post is seen first."""
    seen = parsed.select("blog_url", "page_no", F.posexplode("hrefs").alias("pos", "href"))
    address = resolve_url(F.col("blog_url"), F.col("href"), cfg.protocol_relative)
    return merged_places(seen.withColumn("post_url", address).drop("href"))


def merged_places(places: DataFrame) -> DataFrame:
    return (
        places.groupBy("blog_url", "post_url")
        .agg(F.min(F.struct("page_no", "pos")).alias("at"))
        .select("blog_url", "post_url", "at.page_no", "at.pos")
    )


def _within(places: DataFrame, ends: DataFrame, inside) -> DataFrame:
    """Places that hold `inside` against the ends of their blog; one blog may own most of them."""
    met = skew_join(places, ends, ["blog_url"], "inner", spread_by="post_url")
    return met.filter(inside).select("blog_url", "post_url")


def run_frontier(
    stream: DataFrame, path: str, checkpoint: str, cfg: MigrationConfig = MigrationConfig()
) -> None:
    """Process all list pages available. `path`/released gets, batch by batch, the posts that became
    reachable: those on pages before the blog's end that were not released before, among them posts of
    earlier batches behind a gap that is filled now. A post is released once; see `released`.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        parsed = staged(listed_pages(batch, cfg), "listed")
        marks = tiers.put(page_marks(parsed), f"{path}/pages", batch_id, merged_marks)
        places = tiers.put(first_places(parsed, cfg), f"{path}/places", batch_id, merged_places)
        marks_before = tiers.before(marks, f"{path}/pages", batch_id, merged_marks)
        held = tiers.before(places, f"{path}/places", batch_id, merged_places)
        old = staged(blog_ends(marks_before).withColumnRenamed("end", "old_end"), "old-ends")
        new = blog_ends(merged_marks(marks_before.unionByName(marks)))
        ends = staged(new.join(old, "blog_url", "left").fillna(1, ["old_end"]), "ends")
        page = F.col("page_no")
        moved = ends.filter("end > old_end")
        opened = _within(held, moved, (page >= F.col("old_end")) & (page < F.col("end")))
        arrived = _within(places, ends, page < F.col("end"))
        gone = _within(held.join(places, ["blog_url", "post_url"], "left_semi"), old, page < F.col("old_end"))
        fresh = arrived.join(gone, ["blog_url", "post_url"], "left_anti").union(opened).distinct()
        fresh.write.mode("overwrite").parquet(f"{path}/released/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def released(spark: SparkSession, path: str) -> DataFrame:
    """(blog_url, post_url, batch_id) of all posts released so far."""
    schema = "blog_url STRING, post_url STRING, batch_id BIGINT"
    return spark.read.schema(schema).parquet(f"{path}/released")

"""Planning image uploads and undoing those of failed posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkferry.functions.text import media_file_name
from inkferry.operators.skew import skew_join

DEFAULT_MIME = "application/octet-stream"


def media_plan(
    posts: DataFrame, mimes: DataFrame | None = None, dedupe: bool = False
) -> DataFrame:
    """One pending upload per image use: the featured image (`pos` -1), then the content's images.

    `mimes(image_url, mime)` holds known media types. With `dedupe`, an address is uploaded once, for
    its first use by post and position.
    """
    featured = posts.filter(F.col("featured_image_url").isNotNull()).select(
        "url",
        "title",
        F.lit(-1).alias("pos"),
        F.col("featured_image_url").alias("image_url"),
        F.concat(F.lit("Featured image for "), F.col("title")).alias("alt_text"),
    )
    content = posts.select("url", "title", F.explode("images").alias("i")).select(
        "url", "title", F.col("i.pos").alias("pos"), F.col("i.url").alias("image_url"), F.col("i.alt_text").alias("alt_text")
    )
    uses = featured.unionByName(content)
    if dedupe:
        first = F.min(F.struct("url", "pos", "title", "alt_text")).alias("u")
        uses = uses.groupBy("image_url").agg(first).select("u.*", "image_url")
    mime = F.lit(None).cast("string")
    if mimes is not None:
        one_each = mimes.groupBy("image_url").agg(F.max("mime").alias("mime"))
        uses = skew_join(uses, one_each, ["image_url"], "left", spread_by="url")
        mime = F.col("mime")
    name = media_file_name(F.col("title"), F.coalesce(mime, F.lit(DEFAULT_MIME)))
    return uses.select(
        "url", "pos", "image_url", "alt_text", name.alias("file_name"), F.lit("pending").alias("status")
    )


def _failed_items(items: DataFrame, featured: DataFrame | None) -> DataFrame:
    """Failed items with the address of their featured image, from `featured(job_item_id, image_url)`."""
    failed = items.filter(F.col("status") == "failed").select(F.col("id").alias("job_item_id"))
    if featured is None:
        return failed.withColumn("featured_url", F.lit(None).cast("string"))
    address = featured.groupBy("job_item_id").agg(F.max("image_url").alias("featured_url"))
    return failed.join(address, "job_item_id", "left")


def _uploads_of(failed: DataFrame, assets: DataFrame) -> DataFrame:
    """Uploads of these items, the featured one flagged. One item may own many."""
    uploads = assets.filter((F.col("status") == "uploaded") & F.col("dest_media_id").isNotNull())
    return skew_join(uploads, failed, ["job_item_id"], "inner", spread_by="id").withColumn(
        "is_featured", F.coalesce(F.col("image_url") == F.col("featured_url"), F.lit(False))
    )


def rollback_plan(
    items: DataFrame, assets: DataFrame, featured: DataFrame | None = None
) -> DataFrame:
    """What to delete for each failed item: featured media, content media, then the post.

    Sort by (job_item_id, step, asset_id) to carry it out. Unknown ids are skipped; something already
    gone counts as deleted.
    """
    media = _uploads_of(_failed_items(items, featured), assets).select(
        "job_item_id",
        F.when(F.col("is_featured"), 1).otherwise(2).alias("step"),
        F.lit("media").alias("kind"),
        F.col("dest_media_id").alias("target_id"),
        F.col("id").alias("asset_id"),
    )
    posts = items.filter((F.col("status") == "failed") & F.col("dest_post_id").isNotNull()).select(
        F.col("id").alias("job_item_id"),
        F.lit(3).alias("step"),
        F.lit("post").alias("kind"),
        F.col("dest_post_id").alias("target_id"),
        F.lit(None).cast("bigint").alias("asset_id"),
    )
    return media.unionByName(posts)


def orphaned_media(
    assets: DataFrame, items: DataFrame, featured: DataFrame | None = None
) -> DataFrame:
    """Content uploads that a rollback by the post's image list would miss.

    That list is only filled when all content images were uploaded, so one failed image of an item
    leaves the item's earlier uploads behind.
    """
    broken = assets.filter(F.col("status") == "failed").select("job_item_id").distinct()
    failed = _failed_items(items, featured).join(broken, "job_item_id", "left_semi")
    return (
        _uploads_of(failed, assets)
        .filter(~F.col("is_featured"))
        .select("id", "job_item_id", "image_url", "dest_media_id")
    )

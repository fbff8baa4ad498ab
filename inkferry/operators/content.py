"""Putting post content together: clean form, preview cards and uploaded images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.config import MigrationConfig
from inkferry.functions.text import escape_attribute
from inkferry.operators.extract import parse_stage
from inkferry.operators.lookup import attach_map
from inkferry.operators.normal_form import CARD_CLOSE, CARD_OPEN
from inkferry.operators.previews import preview_cards


def joined(segments: Column) -> Column:
    """The segments' HTML, in order."""
    return F.array_join(F.transform(segments, lambda s: s["html"]), "")


def clean_content(
    pages: DataFrame,
    cfg: MigrationConfig = MigrationConfig(),
    to_markdown: Callable[[Column], Column] | None = None,
    to_html: Callable[[Column], Column] | None = None,
    keep: tuple[str, ...] = ("blog_url", "url"),
) -> DataFrame:
    """The clean form of each page's content, `''` where the page has none.

    `to_markdown` and `to_html` (usually pandas UDFs) replace the two halves of the usual way through
    Markdown: the first gets the raw HTML of the content root instead of it being cleaned here, the
    second gets the result so far.
    """
    if to_markdown is None:
        cleaned = parse_stage(pages, cfg, ("content",), keep)
        content = F.coalesce(joined(F.col("segments")), F.lit(""))
    else:
        cleaned = parse_stage(pages, cfg, ("root_html",), keep)
        root = F.coalesce("root_html", F.lit(""))
        content = F.when(root == "", root).otherwise(to_markdown(root))
    if to_html is not None:
        content = F.when(content == "", content).otherwise(to_html(content))
    return cleaned.select(*keep, content.alias("content"))


def convert_html(
    pages: DataFrame,
    to_markdown: Callable[[Column], Column],
    to_html: Callable[[Column], Column] | None = None,
    html: str = "html",
    out: str = "content",
) -> DataFrame:
    """Add the caller's conversion of an HTML column, with no reading of the page in between.

    The converters are column functions, usually Arrow UDFs. They get no null and no empty text; these
    stay as they are.
    """
    source = F.col(html)
    converted = F.when(source == "", source).otherwise(F.when(source.isNotNull(), to_markdown(source)))
    if to_html is not None:
        pages = pages.withColumn("_converted", converted)
        found = F.col("_converted")
        converted = F.when(found == "", found).otherwise(F.when(found.isNotNull(), to_html(found)))
    return pages.withColumn(out, converted).drop("_converted")


def _with_html(kind: str, html: Callable[[Column], Column]) -> Column:
    return F.transform(
        "segments",
        lambda s: F.when(
            s["kind"] == kind,
            F.struct(s["kind"].alias("kind"), F.coalesce(html(s["key"]), s["html"]).alias("html"), s["key"].alias("key")),
        ).otherwise(s),
    )


def replace_bookmarks(
    posts: DataFrame, previews: DataFrame, id_columns: tuple[str, ...] = ("row_id",)
) -> DataFrame:
    """Put a marked preview card in the place of every bookmark, and its text into the link's context."""
    carded = attach_map(posts, list(id_columns), F.col("bookmarks.url"), preview_cards(previews), "_cards")
    card = lambda key: F.concat(
        F.lit(CARD_OPEN), F.try_element_at("_cards", key)["card"], F.lit(CARD_CLOSE)
    )
    columns = {"segments": _with_html("bookmark", card)}
    if "links" in posts.columns:
        columns["links"] = F.transform(
            "links",
            lambda l: F.when(
                l["kind"] == "card",
                l.withField("context", F.coalesce(l["context"], F.try_element_at("_cards", l["key"])["context"])),
            ).otherwise(l),
        )
    return carded.withColumns(columns).drop("_cards")


def uploaded_images(image_assets: DataFrame) -> DataFrame:
    """The newest upload of each image of an item."""
    return (
        image_assets.filter((F.col("status") == "uploaded") & F.col("dest_media_url").isNotNull())
        .groupBy("job_item_id", F.col("image_url").alias("key"))
        .agg(
            F.max_by(
                F.struct(F.col("dest_media_url").alias("media_url"), F.col("dest_media_id").alias("media_id")),
                "id",
            ).alias("value")
        )
    )


def rewrite_images(
    posts: DataFrame, image_assets: DataFrame, id_columns: tuple[str, ...] = ("row_id",)
) -> DataFrame:
    """Point images at their uploads (matched by `job_item_id` and address) and list the uploads.

    Images without an upload keep their address and are not listed.
    """
    found = attach_map(
        posts,
        list(id_columns),
        F.col("images.url"),
        uploaded_images(image_assets),
        "_uploads",
        item_columns=("job_item_id",),
    )
    uses = F.transform(
        "images",
        lambda i: F.struct(
            i["pos"].alias("pos"),
            i["url"].alias("url"),
            i["alt_text"].alias("alt_text"),
            F.try_element_at("_uploads", i["url"]).alias("upload"),
        ),
    )
    uploaded = F.transform(
        F.filter(uses, lambda i: i["upload"].isNotNull()),
        lambda i: F.struct(
            i["pos"].alias("pos"),
            i["url"].alias("url"),
            i["alt_text"].alias("alt_text"),
            i["upload"]["media_id"].alias("media_id"),
            i["upload"]["media_url"].alias("media_url"),
        ),
    )
    new_address = lambda key: escape_attribute(F.try_element_at("_uploads", key)["media_url"])
    return found.withColumns(
        {"segments": _with_html("image", new_address), "images": uploaded}
    ).drop("_uploads")


def content_retention(
    pages: DataFrame, cfg: MigrationConfig = MigrationConfig(), keep: tuple[str, ...] = ("blog_url", "url")
) -> DataFrame:
    """Visible characters (white space aside) before and after cleaning, per post."""
    parsed = parse_stage(pages, cfg, ("raw_text",), keep)
    visible = lambda c: F.length(F.regexp_replace(c, r"[\s\p{Z}\x{FEFF}]+", ""))
    counted = parsed.select(
        *keep,
        F.coalesce(visible(F.col("raw_text")), F.lit(0)).alias("chars_before"),
        F.coalesce(visible(F.col("clean_text")), F.lit(0)).alias("chars_after"),
    )
    kept = F.when(F.col("chars_before") == 0, F.lit(1.0)).otherwise(
        F.col("chars_after") / F.col("chars_before")
    )
    return counted.withColumn("kept", kept)

"""Structured posts, links, images and bookmarks out of raw HTML pages.

Each page is parsed once, in Arrow batches, into raw texts and nested lists; everything after that is
a column expression or a join. `parts` names what the stage has to produce.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.config import FIRST_IS_PARENT, MigrationConfig
from inkferry.functions.text import (
    js_trim,
    none_if_empty,
    parse_instant,
    resolve_url,
    slugify,
    url_host,
)
from inkferry.operators.dom import WHITE, Page, inner_html
from inkferry.operators.normal_form import NormalForm, page_images, page_links
from inkferry.operators.page_batches import map_pages
from inkferry.operators.skew import number_within, skew_join, staged

MAX_CATEGORIES = 2
PAGES_PER_BLOCK = 1000
INVALID_DATE_MESSAGE = "Invalid time value"
INVALID_ADDRESS_MESSAGE = "Invalid URL"

_TEXT = pa.string()
_IMAGE = pa.struct([("pos", pa.int32()), ("url", _TEXT), ("alt_text", _TEXT)])
_BOOKMARK = pa.struct([("pos", pa.int32()), ("url", _TEXT)])
_SEGMENT = pa.struct([("kind", _TEXT), ("html", _TEXT), ("key", _TEXT)])
_LINK = pa.struct(
    [
        ("pos", pa.int32()),
        ("kind", _TEXT),
        ("key", _TEXT),
        ("target_url", _TEXT),
        ("target_host", _TEXT),
        ("link_text", _TEXT),
        ("context", _TEXT),
    ]
)
PARTS = {
    "meta": {
        "title_raw": _TEXT,
        "publish_raw": _TEXT,
        "modified_raw": _TEXT,
        "category_names": pa.list_(_TEXT),
        "tag_names": pa.list_(_TEXT),
        "featured_style": _TEXT,
    },
    "bookmarks": {"bookmarks": pa.list_(_BOOKMARK)},
    "content": {
        "segments": pa.list_(_SEGMENT),
        "images": pa.list_(_IMAGE),
        "links": pa.list_(_LINK),
    },
    "root_html": {"root_html": _TEXT},
    "raw_text": {"raw_text": _TEXT, "clean_text": _TEXT},
    "page_links": {"page_links": pa.list_(_LINK)},
    "page_images": {"page_images": pa.list_(_IMAGE)},
    "list_links": {"hrefs": pa.list_(_TEXT)},
}


def _raw_value(page: Page, selector: str, attributes: tuple[str, ...]) -> str:
    """First non-empty attribute of the first match, else its text."""
    node = page.first(selector)
    if node is None:
        return ""
    return next((node.attrs[a] for a in attributes if node.attrs.get(a)), None) or node.text()


def _origin(url: str) -> str:
    scheme, _, rest = url.partition("://")
    for mark in "/?#":
        rest = rest.partition(mark)[0]
    return f"{scheme}://{rest}"


def _parse_page(source: str, origin: str, cfg: MigrationConfig, parts: tuple[str, ...]) -> dict:
    page = Page(source)
    out: dict = {}
    if "meta" in parts:
        featured = page.first(cfg.featured_image_selector)
        out["title_raw"] = _raw_value(page, cfg.title_selector, ("content",))
        out["publish_raw"] = _raw_value(page, cfg.publish_date_selector, ("content", "datetime"))
        out["modified_raw"] = _raw_value(page, cfg.modified_date_selector, ("content", "datetime"))
        out["category_names"] = [n.text() for n in page.select(cfg.category_selector)]
        out["tag_names"] = [n.text() for n in page.select(cfg.tag_selector)]
        out["featured_style"] = featured.attrs.get("style") if featured is not None else None
    if "bookmarks" in parts or "content" in parts:
        found = {}
        for place, node in enumerate(page.select(cfg.bookmark_selector)):
            anchor = next((e for e in node.elements() if e.tag == "a"), None)
            if anchor is not None and anchor.attrs.get("href"):
                found[id(node)] = (place, anchor.attrs["href"])
        out["bookmarks"] = [{"pos": place, "url": url} for place, url in found.values()]
    if "root_html" in parts:
        root = page.first(cfg.content_selector)
        out["root_html"] = inner_html(root) if root is not None else ""
    if "content" in parts or "raw_text" in parts:
        root = page.first(cfg.content_selector)
        form = NormalForm(found if "content" in parts else {}, origin)
        if root is not None:
            form.run(root)
        out["segments"], out["images"], out["links"] = form.segments, form.images, form.links.rows
        if "raw_text" in parts:
            for hidden in [n for n in page.elements if n.tag in ("script", "style", "noscript")]:
                hidden.children = []
            clean = Page("".join(s["html"] for s in form.segments))
            out["raw_text"] = root.text() if root is not None else ""
            out["clean_text"] = clean.root.text()
    if "page_links" in parts:
        out["page_links"] = page_links(page.root, origin)
    if "page_images" in parts:
        out["page_images"] = page_images(page.root)
    if "list_links" in parts:
        hrefs = (n.attrs.get("href") for n in page.select(cfg.list_link_selector))
        out["hrefs"] = [h for h in hrefs if h]
    return out


def parse_stage(
    pages: DataFrame,
    cfg: MigrationConfig,
    parts: tuple[str, ...],
    keep: tuple[str, ...] = ("blog_url", "url"),
    origin: str = "blog_url",
) -> DataFrame:
    """One pass over the pages: the `keep` columns, the columns of `parts`, and `parse_error`.

    Links are resolved against the origin of the address in the column `origin`.
    """
    fields = {name: kind for part in parts for name, kind in PARTS[part].items()}

    def parse(source: str | None, address: str | None) -> dict:
        return _parse_page((source or "").strip(WHITE), _origin(address or ""), cfg, parts)

    source = pages.select(*keep, F.col(origin).alias("_origin"), F.col("html").alias("_html"))
    return map_pages(source, keep, ("_html", "_origin"), fields, parse)


# --- columns of a parsed post ---


def title(raw: Column) -> Column:
    return F.coalesce(none_if_empty(js_trim(raw)), F.lit("Untitled"))


def named_terms(names: Column) -> Column:
    """Trimmed non-empty names with slugs, in order, duplicates kept."""
    trimmed = F.filter(F.transform(names, js_trim), lambda n: n != "")
    return F.transform(
        trimmed,
        lambda n, i: F.struct(i.cast("int").alias("pos"), n.alias("name"), slugify(n).alias("slug")),
    )


def category_tree(names: Column, order: str = FIRST_IS_PARENT) -> Column:
    """The first two categories; with two, one is the other's parent."""
    first_two = F.slice(named_terms(names), 1, MAX_CATEGORIES)
    child, parent = (1, 0) if order == FIRST_IS_PARENT else (0, 1)
    parent_name = F.when(
        (F.size(first_two) == MAX_CATEGORIES), F.get(first_two, F.lit(parent))["name"]
    )
    return F.transform(
        first_two,
        lambda c: F.struct(
            c["pos"].alias("pos"),
            c["name"].alias("name"),
            c["slug"].alias("slug"),
            F.when(c["pos"] == child, parent_name).alias("parent_name"),
        ),
    )


def featured_image(style: Column, blog_url: Column, protocol_relative: bool = False) -> Column:
    address = none_if_empty(
        F.regexp_extract(style, r"""background-image:\s*url\(["']?(.*?)["']?\)""", 1)
    )
    return F.when(address.isNotNull(), resolve_url(blog_url, address, protocol_relative))


def meta_columns(cfg: MigrationConfig) -> dict[str, Column]:
    publish, modified = js_trim(F.col("publish_raw")), js_trim(F.col("modified_raw"))
    return {
        "title": title(F.col("title_raw")),
        "publish_date": parse_instant(publish),
        "publish_date_invalid": parse_instant(publish).isNull(),
        "modified_date": parse_instant(none_if_empty(modified)),
        "categories": category_tree(F.col("category_names"), cfg.category_order),
        "tags": named_terms(F.col("tag_names")),
        "featured_image_url": featured_image(
            F.col("featured_style"), F.col("blog_url"), cfg.protocol_relative
        ),
    }


def parse_posts(
    pages: DataFrame,
    cfg: MigrationConfig = MigrationConfig(),
    parts: tuple[str, ...] = ("meta", "bookmarks", "content"),
    keep: tuple[str, ...] = ("blog_url", "url"),
) -> DataFrame:
    """Posts with metadata, bookmarks, content segments, images and links.

    The result feeds several joins: write it with `skew.staged` first, so that pages are parsed once
    and later steps read only the columns they need. `row_id` then names each row for good, and later
    joins use it, so copies of a page neither mix nor gather in one task. Streams have no `row_id`.
    """
    parsed = parse_stage(pages, cfg, parts, keep)
    if "meta" in parts:
        raw = PARTS["meta"].keys()
        others = [c for c in parsed.columns if c not in raw]
        meta = [column.alias(name) for name, column in meta_columns(cfg).items()]
        parsed = parsed.select(*others, *meta)
    return parsed if pages.isStreaming else parsed.withColumn("row_id", F.monotonically_increasing_id())


def _problem() -> Column:
    """Stage and message of what stops a post first, NULL if nothing does."""

    def problem(stage: str, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.struct(F.lit(stage).alias("stage"), text.alias("message"))

    address = F.col("featured_image_url")
    return (
        F.when(F.col("parse_error").isNotNull(), problem("parse", F.col("parse_error")))
        .when(F.col("publish_date_invalid"), problem("publish date", INVALID_DATE_MESSAGE))
        .when(
            address.isNotNull() & url_host(address).isNull(),
            problem("featured image", INVALID_ADDRESS_MESSAGE),
        )
    )


def is_refused() -> Column:
    return _problem().isNotNull()


def post_errors(posts: DataFrame) -> DataFrame:
    """Posts that cannot go on, with the stage and message that a failed item records."""
    return (
        posts.select("blog_url", "url", _problem().alias("problem"))
        .filter("problem IS NOT NULL")
        .select("blog_url", "url", "problem.stage", "problem.message")
    )


def bookmarks(posts: DataFrame) -> DataFrame:
    """Link previews on a page; `pos` counts all matches, so it can have gaps."""
    return posts.select("url", F.explode("bookmarks").alias("b")).select(
        "url", F.col("b.pos").alias("pos"), F.col("b.url").alias("bookmark_url")
    )


def post_images(posts: DataFrame) -> DataFrame:
    return posts.select("url", F.explode("images").alias("i")).select(
        "url", F.col("i.pos").alias("pos"), F.col("i.url").alias("image_url"), F.col("i.alt_text").alias("alt_text")
    )


def internal_links(posts: DataFrame, links: str = "links", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Links that stay on the blog's host, duplicates kept, `pos` in document order."""
    return (
        posts.select(*keep, url_host(F.col("blog_url")).alias("_host"), F.explode(links).alias("l"))
        .filter(F.col("l.target_host") == F.col("_host"))
        .select(
            *keep,
            F.col("l.pos").alias("pos"),
            F.col("l.target_url").alias("target_url"),
            F.col("l.link_text").alias("link_text"),
            F.col("l.context").alias("context"),
        )
    )


# --- discovery ---


def discover_post_urls(list_pages: DataFrame, cfg: MigrationConfig = MigrationConfig()) -> DataFrame:
    """Posts linked from each blog's list pages 1, 2, ... up to the first missing or empty page.

    `page_no` and `pos` are the place where a post is seen first.
    """
    parsed = parse_stage(list_pages, cfg, ("list_links",), ("blog_url", "page_no"))
    hrefs = F.coalesce("hrefs", F.array().cast("array<string>")).alias("hrefs")
    return first_seen_posts(staged(parsed.select("blog_url", "page_no", hrefs), "list-links"), cfg)


def first_seen_posts(parsed: DataFrame, cfg: MigrationConfig = MigrationConfig()) -> DataFrame:
    """Each page also marks page 1 and its successor, so a blog ends at the first page that is marked
    but has no links. That takes one aggregation by (blog, page) and no window over a whole blog.
    """
    filled = F.size("hrefs") > 0
    mark = lambda page_no, with_links: F.struct(page_no.alias("page_no"), with_links.alias("filled"))
    marks = F.array(
        mark(F.col("page_no"), filled),
        mark(F.col("page_no") + 1, F.lit(False)),
        mark(F.lit(1).cast("bigint"), F.lit(False)),
    )
    ends = (
        parsed.select("blog_url", F.explode(marks).alias("m"))
        .groupBy("blog_url", "m.page_no")
        .agg(F.bool_or("m.filled").alias("filled"))
        .filter("NOT filled")
        .groupBy("blog_url")
        .agg(F.min("page_no").alias("_end"))
    )
    read = skew_join(parsed, ends, ["blog_url"], "inner", spread_by="page_no")
    seen = (
        read.filter(F.col("page_no") < F.col("_end"))
        .select("blog_url", "page_no", F.posexplode("hrefs").alias("pos", "href"))
        .withColumn("post_url", resolve_url(F.col("blog_url"), F.col("href"), cfg.protocol_relative))
    )
    return (
        seen.groupBy("blog_url", "post_url")
        .agg(F.min(F.struct("page_no", "pos")).alias("at"))
        .select("blog_url", "post_url", "at.page_no", "at.pos")
    )


def number_discovered(discovered: DataFrame) -> DataFrame:
    """Discovered posts with their place `n` in the blog's crawl order."""
    return number_within(
        discovered, ["blog_url"], ["page_no", "pos"], "n", block=F.floor(F.col("page_no") / PAGES_PER_BLOCK)
    )

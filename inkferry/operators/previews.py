"""Link previews: metadata of the linked pages and the card that replaces a bookmark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.functions.text import escape_html, js_trim, none_if_empty, resolve_origin
from inkferry.operators.dom import Page
from inkferry.operators.page_batches import map_pages

NOT_FETCHED = "page could not be fetched"
CONTEXT_LENGTH = 50

# The card's layout. The places of the values are marked {like_this}; the two optional
# parts are rendered first.
CARD_STYLE = (
    "border: 1px solid #e5e7eb; border-radius: 10px; overflow: hidden; background-color: #ffffff; "
    "box-shadow: 0 2px 6px rgba(0, 0, 0, 0.05); margin: 12px 0; min-height: 80px; position: relative"
)
OVERLAY_STYLE = "position: absolute; inset: 0; display: block; z-index: 3; text-decoration: none"
ROW_STYLE = "display: flex; gap: 14px; align-items: stretch; position: relative; z-index: 1"
IMAGE_BOX_STYLE = "position: relative; background-color: #f3f4f6; overflow: hidden; flex: 0 0 30%"
IMAGE_STYLE = "width: 100%; height: 100%; object-fit: cover; display: block"
CONTENT_STYLE = (
    "padding: 12px 14px; display: flex; flex-direction: column; justify-content: center; flex: 1"
)
TITLE_STYLE = (
    "margin: 0 0 4px 0; font-size: 0.95rem; font-weight: 500; color: #111827; line-height: 1.3; "
    "overflow-wrap: anywhere"
)
DESCRIPTION_STYLE = (
    "margin: 4px 0 0 0; font-size: 0.85rem; color: #6b7280; line-height: 1.4; max-height: 3.6em; "
    "overflow: hidden"
)
CARD = (
    f'<figure class="bookmark-card" style="{CARD_STYLE}">\n'
    f'    <a class="bookmark-overlay-link" href="{{url}}" target="_blank" rel="noopener noreferrer" '
    f'aria-label="{{title}}" style="{OVERLAY_STYLE}"></a>\n'
    f'    <div class="bookmark-row" style="{ROW_STYLE}">\n'
    f'    <div class="bookmark-featured-image" style="{IMAGE_BOX_STYLE}">{{image}}</div>\n'
    f'    <div class="bookmark-content" style="{CONTENT_STYLE}">\n'
    f'      <p class="bookmark-title" style="{TITLE_STYLE}">\n'
    f"        {{title}}\n"
    f"      </p>\n"
    f"      {{description}}\n"
    f"    </div>\n"
    f"  </div>\n"
    f"  </figure>"
)
CARD_IMAGE = f'\n        <img src="{{image_url}}" alt="{{title}}" style="{IMAGE_STYLE}" />\n      '
CARD_DESCRIPTION = f'<p class="bookmark-description" style="{DESCRIPTION_STYLE}">{{text}}</p>'
# The same card as plain text: what a reader of the text nodes sees.
CARD_TEXT = "\n    \n    \n    {image}\n    \n      \n        {title}\n      \n      {description}\n    \n  \n  "
CARD_TEXT_IMAGE = "\n        \n      "

_FIELDS = {
    "fetched": pa.bool_(),
    "og_title": pa.string(),
    "title_text": pa.string(),
    "og_description": pa.string(),
    "og_image": pa.string(),
    "icon": pa.string(),
}


def _fill(template: str, values: dict[str, Column]) -> Column:
    """The template as one `concat`, so that a value is never scanned for further marks."""
    parts: list[Column] = []
    for chunk in template.split("{"):
        name, mark, rest = chunk.partition("}")
        if mark and name in values:
            parts += [values[name], F.lit(rest)]
        else:
            parts.append(F.lit(chunk if not parts else "{" + chunk))
    return F.concat(*parts)


def _read_head(source: str | None) -> dict:
    if source is None:
        return {"fetched": False}
    page = Page(source)

    def attribute(selector: str, name: str) -> str | None:
        node = page.first(selector)
        return node.attrs.get(name) or None if node is not None else None

    return {
        "fetched": True,
        "og_title": attribute('meta[property="og:title"]', "content"),
        "title_text": "".join(n.text() for n in page.select("title")) or None,
        "og_description": attribute('meta[property="og:description"]', "content"),
        "og_image": attribute('meta[property="og:image"]', "content"),
        "icon": attribute('link[rel="icon"]', "href")
        or attribute('link[rel="shortcut icon"]', "href")
        or attribute('link[rel="apple-touch-icon"]', "href"),
    }


def preview_metadata(bookmarks: DataFrame, fetched_pages: DataFrame) -> DataFrame:
    """Title, description and image of every distinct bookmark address.

    Fetched pages are parsed where they are read, so that only their few texts are shuffled. An
    address without a fetched page keeps its address as title and carries an error.
    """
    wanted = bookmarks.select(F.col("bookmark_url").alias("url")).distinct()
    parsed = map_pages(fetched_pages.select("url", "html"), ("url",), ("html",), _FIELDS, _read_head)
    # one row per address, also when a page was fetched several times
    one_each = parsed.groupBy("url").agg(F.max(F.struct(*parsed.columns[1:])).alias("p"))
    heads = wanted.join(one_each.select("url", "p.*"), "url", "left")
    icon = F.when(F.col("icon").isNotNull(), resolve_origin(F.col("url"), F.col("icon")))
    return heads.select(
        "url",
        F.coalesce("og_title", "title_text", "url").alias("title"),
        F.col("og_description").alias("description"),
        F.coalesce(F.col("og_image"), icon).alias("image"),
        F.coalesce(
            "parse_error", F.when(~F.coalesce("fetched", F.lit(False)), F.lit(NOT_FETCHED))
        ).alias("error"),
    )


def _shown_title(title: Column, url: Column) -> Column:
    return F.coalesce(F.when(js_trim(title) != "", title), url)


def render_card(url: Column, title: Column, description: Column, image: Column) -> Column:
    """The preview card's HTML; image and description may be NULL or empty."""
    shown = escape_html(_shown_title(title, url))
    image_html = _fill(CARD_IMAGE, {"image_url": escape_html(image), "title": shown})
    description_html = _fill(CARD_DESCRIPTION, {"text": escape_html(description)})
    return _fill(
        CARD,
        {
            "url": escape_html(url),
            "title": shown,
            "image": F.coalesce(F.when(none_if_empty(image).isNotNull(), image_html), F.lit("")),
            "description": F.coalesce(
                F.when(none_if_empty(description).isNotNull(), description_html), F.lit("")
            ),
        },
    )


def card_context(url: Column, title: Column, description: Column, image: Column) -> Column:
    """Link context of the card's overlay link, which has no text of its own."""
    text = _fill(
        CARD_TEXT,
        {
            "title": _shown_title(title, url),
            "image": F.when(none_if_empty(image).isNotNull(), CARD_TEXT_IMAGE).otherwise(""),
            "description": F.coalesce(description, F.lit("")),
        },
    )
    return js_trim(F.substring(text, 1, CONTEXT_LENGTH))


def preview_cards(previews: DataFrame) -> DataFrame:
    """Card and link context per address, in the shape that `content.replace_bookmarks` looks up."""
    args = (F.col("url"), F.col("title"), F.col("description"), F.col("image"))
    return previews.select(
        F.col("url").alias("key"),
        F.struct(render_card(*args).alias("card"), card_context(*args).alias("context")).alias("value"),
    )

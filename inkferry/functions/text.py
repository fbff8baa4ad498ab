"""Text expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the source platform's runtime strips as white space. Java's \s is ASCII only.
_WHITE = r"[\s\p{Z}\x{FEFF}]"
_LEADING = rf"^{_WHITE}++"
# the trailing run is tried once, from its start, so long inner runs cost nothing extra
_TRAILING = rf"(?<!{_WHITE}){_WHITE}++$"

# File extension per media type; anything else is stored as "bin".
MEDIA_EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "image/bmp": "bmp",
    "image/tiff": "tiff",
}
FILE_PREFIX_LENGTH = 15
_DAYS = ("MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy")
_CLOCKS = ("[ H:mm[:ss]]", " h:mm[:ss] a", " H:mm:ss 'GMT'xx")
DATE_FORMATS = (
    "yyyy/M/d[ H:mm[:ss]]",
    "yyyy-M-d[ H:mm[:ss]]",
    *[day + clock for day in _DAYS for clock in _CLOCKS],
    "d MMM yyyy HH:mm:ss z",
)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _LEADING, ""), _TRAILING, "")


def none_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def slugify(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(js_trim(name)), rf"{_WHITE}+", "-")
    return F.regexp_replace(dashed, r"[^\p{L}\p{N}-]+", "")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_attribute(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), (" ", "&nbsp;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _is_absolute(path: Column) -> Column:
    return path.startswith("http://") | path.startswith("https://")


def _joined(base: Column, path: Column) -> Column:
    return F.concat(base, F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/")), path)


def resolve_url(blog_url: Column, path: Column, protocol_relative: bool = False) -> Column:
    """Absolute http(s) addresses stay; anything else is a path below the blog's address.

    `//host/x` counts as a path unless `protocol_relative` is set.
    """
    below = _joined(F.regexp_replace(blog_url, "/$", ""), path)
    resolved = F.when(_is_absolute(path), path)
    if protocol_relative:
        scheme = F.regexp_extract(blog_url, "^(https?:)", 1)
        resolved = resolved.when(path.startswith("//"), F.concat(scheme, path))
    return resolved.otherwise(below)


def resolve_origin(url: Column, path: Column) -> Column:
    """Like `resolve_url`, but a path hangs below the site's origin."""
    origin = F.regexp_extract(url, "^(https?://[^/?#]+)", 1)
    return F.when(_is_absolute(path), path).otherwise(_joined(origin, path))


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def list_page_url(blog_url: Column, page_no: Column) -> Column:
    separator = F.when(F.contains(blog_url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    later = F.concat(blog_url, separator, F.lit("page="), page_no.cast("string"))
    return F.when(page_no == 1, blog_url).otherwise(later)


def list_page_urls(blogs: DataFrame, n_pages: int) -> DataFrame:
    """Addresses of list pages 1..n of every blog."""
    return blogs.select(
        "blog_url", F.explode(F.sequence(F.lit(1), F.lit(n_pages))).alias("page_no")
    ).withColumn("page_url", list_page_url(F.col("blog_url"), F.col("page_no")))


def media_file_name(title: Column, mime: Column, index: Column | None = None) -> Column:
    """Upload name: start of the title, optional 1-based index, extension of the media type."""
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    prefix = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, FILE_PREFIX_LENGTH)
    extensions = F.create_map(*[F.lit(x) for pair in MEDIA_EXTENSIONS.items() for x in pair])
    extension = F.coalesce(F.try_element_at(extensions, mime), F.lit("bin"))
    number = F.lit("") if index is None else F.concat(F.lit("-"), (index + 1).cast("string"))
    return F.concat(prefix, F.lit("-image"), number, F.lit("."), extension)


def parse_instant(text: Column) -> Column:
    """Timestamp of a date text, NULL when it cannot be read.

    A bare time of day is no date, although a cast would place it on the current day.
    """
    plain_date = text.rlike(r"^\d{4}-\d{2}-\d{2}$")  # means midnight UTC in any session
    readings = [
        F.when(plain_date, F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))
        .when(text.rlike(r"^\d{4}"), F.try_to_timestamp(text))
    ]
    # a leading day of the week and a trailing remark in brackets say nothing new
    named_day = text.rlike(r"^(?i)(mon|tue|wed|thu|fri|sat|sun)")
    bare = F.regexp_replace(text, r"^[A-Za-z]{3,9},? (?=[A-Z0-9])|\s*\([^()]*\)$", "")
    bare = F.when(named_day, bare).otherwise(text)
    tried = F.transform(
        F.array(*[F.lit(f) for f in DATE_FORMATS]), lambda f: F.try_to_timestamp(bare, f)
    )
    readings.append(F.get(F.filter(tried, lambda t: t.isNotNull()), F.lit(0)))
    return F.coalesce(*readings)


def utc_wall(instant: Column) -> Column:
    """UTC clock time without a zone, whatever the session's zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def iso_utc(instant: Column) -> Column:
    return F.date_format(utc_wall(instant), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

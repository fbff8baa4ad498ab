import pytest
from pyspark.sql import functions as F

from inkferry.config import LAST_IS_PARENT, ConfigurationError, MigrationConfig
from inkferry.functions import text
from inkferry.operators import extract
from inkferry.operators.dom import Page, absolute_url, compile_selector, outer_html

BLOG = "https://example.blog.com"
CFG = MigrationConfig()


def pages(spark, *sources, blog=BLOG):
    rows = [(blog, f"{blog}/{n}", s) for n, s in enumerate(sources)]
    return spark.createDataFrame(rows, "blog_url string, url string, html string")


def first(spark, source, cfg=CFG):
    return extract.parse_posts(pages(spark, source), cfg).withColumn(
        "publish_text", text.iso_utc(F.col("publish_date"))
    ).first()


META = """<html><head><meta name="title" content="My Test Post" />
<meta property="article:published_time" content="2025-01-01" />
<meta property="article:modified_time" content="2025-01-02" /></head><body>
<div class="another_category"><h4><a href="/category/tech"> Tech </a></h4><h4><a>Programming</a></h4><h4><a>Third</a></h4></div>
<div class="area_tag"><a rel="tag">TypeScript</a> <a rel="tag"> </a><a rel="tag">Node.js</a><a rel="other">no</a></div></body></html>"""


def test_metadata(spark):
    post = first(spark, META)
    assert post.title == "My Test Post"
    assert post.publish_text == "2025-01-01T00:00:00.000Z"
    assert post.modified_date.isoformat()[:10] == "2025-01-02"
    assert [(c.pos, c.name, c.slug, c.parent_name) for c in post.categories] == [
        (0, "Tech", "tech", None),
        (1, "Programming", "programming", "Tech"),
    ]
    assert [(t.name, t.slug) for t in post.tags] == [("TypeScript", "typescript"), ("Node.js", "nodejs")]


def test_last_is_parent(spark):
    post = first(spark, META, MigrationConfig(category_order=LAST_IS_PARENT))
    assert [(c.name, c.parent_name) for c in post.categories] == [("Tech", "Programming"), ("Programming", None)]


def test_missing_parts(spark):
    post = first(spark, "<p>nothing</p>")
    assert (post.title, post.categories, post.tags, post.modified_date) == ("Untitled", [], [], None)
    assert post.publish_date is None and post.publish_date_invalid
    assert post.featured_image_url is None and post.segments == [] and post.bookmarks == []


def test_title_choice_is_made_before_trimming(spark):
    assert first(spark, '<meta name="title" content="  ">').title == "Untitled"
    cfg = MigrationConfig(title_selector="h1")
    assert first(spark, "<h1>  Über <b>uns</b>\n</h1>", cfg).title == "Über uns"


@pytest.mark.parametrize(
    "style, address",
    [
        ("background-image: url(&quot;https://img/f.jpg&quot;);", "https://img/f.jpg"),
        ("background-image: url('https://img/f.jpg');", "https://img/f.jpg"),
        ("background-image:url(https://img/f.jpg)", "https://img/f.jpg"),
        ("background-image: url(/images/f.jpg);", f"{BLOG}/images/f.jpg"),
        ("color: red; margin: 10px;", None),
        ("background-image: url()", None),
    ],
)
def test_featured_image(spark, style, address):
    source = (
        '<div id="main"><div><div><div class="article_header type_article_header_cover">'
        f'<div style="{style}"></div></div></div></div></div>'
    )
    assert first(spark, source).featured_image_url == address


def test_slug_keeps_letters_of_all_scripts(spark):
    names = ["개발 일지 C++", " A  B　c ", "Node.js", "ÄÖ-ü_1", "!!"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r[0] for r in df.select(text.slugify(F.col("name"))).collect()]
    assert got == ["개발-일지-c", "a-b-c", "nodejs", "äö-ü1", ""]


def test_trim_covers_unicode_spaces(spark):
    df = spark.createDataFrame([("﻿ 　\t\n a b  \v",)], "s string")
    assert df.select(text.js_trim(F.col("s"))).first()[0] == "a b"
    odd = ["", " ", "a", " a", "a ", "a" + " " * 200_000 + "b", "\n\n a\n"]
    df = spark.createDataFrame([(o,) for o in odd], "s string")
    assert [r[0] for r in df.select(text.js_trim(F.col("s"))).collect()] == [o.strip() for o in odd]


def test_bookmark_places_can_have_gaps(spark):
    mark = '<figure data-ke-type="opengraph">{}</figure>'
    source = mark.format('<a href="https://e/1">1</a>') + mark.format("<a>none</a>") + mark.format(
        '<a href="https://e/3"><img src="x"></a>'
    )
    got = extract.bookmarks(extract.parse_posts(pages(spark, source))).collect()
    assert [(b.pos, b.bookmark_url) for b in got] == [(0, "https://e/1"), (2, "https://e/3")]


def links(spark, source, blog=BLOG):
    parsed = extract.parse_stage(pages(spark, source, blog=blog), CFG, ("page_links",))
    return [
        (r.target_url, r.link_text, r.context)
        for r in extract.internal_links(parsed, "page_links").orderBy("pos").collect()
    ]


def test_internal_links(spark):
    source = (
        f'<p>Test with <a href="{BLOG}/123?param=value#section">link</a></p><p>x <a href="https://other.com/456">e</a></p>'
        f"<p>Empty <a href='/9'></a> here</p><p><a href=\"javascript:alert('x')\">bad</a> <a href='http://'>bad</a></p>"
        '<p><a href="">none</a><a href="#top">f</a></p><p><a href="http://EXAMPLE.blog.com:8080/a b">port</a></p>'
    )
    assert links(spark, source) == [
        (f"{BLOG}/123?param=value#section", "link", "Test with link"),
        (f"{BLOG}/9", "", "Empty  here"),
        (f"{BLOG}/#top", "f", "nonef"),
        ("http://example.blog.com:8080/a%20b", "port", "port"),
    ]


def test_context_is_cut_at_the_first_place_of_the_text(spark):
    before, after = "b" * 80, "a" * 80
    source = f'<p>{before}link{after}<a href="/1">link</a></p>'
    assert links(spark, source)[0][2] == "b" * 50 + "link" + "a" * 50


def test_images_outside_cards(spark):
    source = (
        '<figure class="x bookmark-card"><img src="a.jpg"></figure><img src="b.jpg" alt="B"><img alt="none">'
        '<img src=""><p><img src="b.jpg"></p>'
    )
    parsed = extract.parse_stage(pages(spark, source), CFG, ("page_images",)).first()
    assert [(i.pos, i.url, i.alt_text) for i in parsed.page_images] == [(0, "b.jpg", "B"), (1, "b.jpg", None)]


def test_discovery_order_and_end(spark):
    page = lambda *hrefs: "".join(f'<a class="link_category" href="{h}">p</a>' for h in hrefs)
    other = "https://two.blog.com/"
    rows = [
        (BLOG, 1, page("/1", "/2", "/1", "")),
        (BLOG, 2, page("/3", "/1")),
        (BLOG, 2, page("/3", "/1")),
        (BLOG, 4, page("/4")),
        (other, 1, page("x")),
        (other, 2, "<p>No posts available.</p>"),
        (other, 3, page("/late")),
        ("https://three.blog.com", 2, page("/1")),
    ]
    df = spark.createDataFrame(rows, "blog_url string, page_no long, html string")
    got = extract.number_discovered(extract.discover_post_urls(df, CFG)).orderBy("blog_url", "n").collect()
    assert [(r.post_url, r.n) for r in got] == [(f"{BLOG}/1", 1), (f"{BLOG}/2", 2), (f"{BLOG}/3", 3), (f"{other}x", 1)]


def test_resolve_urls(spark):
    df = spark.createDataFrame([("/1",), ("1",), ("//cdn/x",), ("https://o/x",), ("httpx",)], "p string")
    blog = F.lit(BLOG + "/")
    got = [r[0] for r in df.select(text.resolve_url(blog, F.col("p"))).collect()]
    assert got == [f"{BLOG}/1", f"{BLOG}/1", f"{BLOG}//cdn/x", "https://o/x", f"{BLOG}/httpx"]
    got = [r[0] for r in df.select(text.resolve_url(blog, F.col("p"), protocol_relative=True)).collect()]
    assert got[2] == "https://cdn/x"
    origin = text.resolve_origin(F.lit("https://s.org/a/b?c"), F.col("p"))
    assert [r[0] for r in df.select(origin).collect()][:2] == ["https://s.org/1", "https://s.org/1"]


def test_deep_pages_keep_their_text(spark):
    deep = "<div><b>" * 30_000 + "x<p>y</p>" + "</b></div>" * 30_000 + "<p>z</p>"
    source = f'<div class="tt_article_useless_p_margin contents_style">{deep}</div>'
    post = extract.parse_posts(pages(spark, source), CFG, ("content",)).first()
    html = "".join(s.html for s in post.segments)
    assert post.parse_error is None and [c for c in Page(html).root.text() if c.isalpha()] == ["x", "y", "z"]


def test_date_texts(spark):
    texts = {
        "2024-01-15T10:00:00+09:00": "2024-01-15T01:00:00.000Z",
        "2025-01-01": "2025-01-01T00:00:00.000Z",
        "2024/1/5 9:30": "2024-01-05T09:30:00.000Z",
        "2024-1-5": "2024-01-05T00:00:00.000Z",
        "Mon, 15 Jan 2024 10:00:00 GMT": "2024-01-15T10:00:00.000Z",
        "Jan 5, 2024": "2024-01-05T00:00:00.000Z",
        "Jan 15 2024": "2024-01-15T00:00:00.000Z",
        "15 January 2024": "2024-01-15T00:00:00.000Z",
        "1/15/2024": "2024-01-15T00:00:00.000Z",
        "January 15, 2024 10:00 PM": "2024-01-15T22:00:00.000Z",
        "Mon Jan 15 2024 10:00:00 GMT+0900": "2024-01-15T01:00:00.000Z",
        "Mon Jan 15 2024 10:00:00 GMT+0900 (KST)": "2024-01-15T01:00:00.000Z",
        "10:00:00": None, "T10:00": None, "not-a-date": None, "": None, "2024-13-45": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in df.select("t", text.iso_utc(text.parse_instant(F.col("t"))).alias("v")).collect()}
    assert got == texts


def test_errors_are_rows(spark):
    good = '<meta property="article:published_time" content="2025-01-01">'
    posts = extract.parse_posts(pages(spark, good, "<p>no date</p>", good))
    broken = F.when(F.col("url").endswith("/2"), F.lit("ValueError: x"))
    errors = extract.post_errors(posts.withColumn("parse_error", broken)).collect()
    assert sorted((e.url[-1], e.stage, e.message) for e in errors) == [
        ("1", "publish date", "Invalid time value"),
        ("2", "parse", "ValueError: x"),
    ]


def test_an_unusable_featured_address_is_an_error(spark):
    date = '<meta property="article:published_time" content="2025-01-01">'
    cover = '<div id="main"><div><div><div class="article_header type_article_header_cover"><div style="background-image:url({})"></div></div></div></div></div>'
    posts = extract.parse_posts(pages(spark, date + cover.format("http://[bad"), date + cover.format("/ok.jpg")))
    errors = extract.post_errors(posts).collect()
    assert [(e.url[-1], e.stage, e.message) for e in errors] == [("0", "featured image", "Invalid URL")]


def test_tree_repairs_markup():
    page = Page("<ul><li>a<li>b<b>c</ul><p>d<p title='x>y' data-q=\"a'b\">e<table><tr><td>1<td>2<tr><td>3</table>f")
    assert outer_html(page.root) == (
        "<#root><ul><li>a</li><li>b<b>c</b></li></ul><p>d</p><p title=\"x>y\" data-q=\"a'b\">e</p>"
        "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>f</#root>"
    )
    assert Page("<title>a<b</title><script>if(a<b){'</p>'}</script>x<!-- <p> -->y<").root.text().endswith("xy<")


def test_selectors():
    page = Page('<div id="m" class="a b"><p><a rel="tag nofollow" href="https://x">1</a></p><a>2</a></div><a>3</a>')
    texts = lambda s: [n.text() for n in page.select(s)]
    assert texts("div.a.b > a") == ["2"]
    assert texts("#m a") == ["1", "2"]
    assert texts('a[rel~="tag"], a[href^="https"]') == ["1"]
    assert texts("*[href]") == ["1"]
    for bad in ("", "a:first", "a >", "a + b"):
        with pytest.raises(ValueError):
            compile_selector(bad)


@pytest.mark.parametrize(
    "href, address",
    [
        ("/글?q=한#é", "https://b.com/%EA%B8%80?q=%ED%95%9C#%C3%A9"),
        ("HTTPS://EX.com:443", "https://ex.com/"),
        ("//Cdn.x/a/../b/.", "https://cdn.x/b/"),
        ("\\x\\y", "https://b.com/x/y"),
        (" \n/a\tb ", "https://b.com/ab"),
        ("mailto:a@b", "mailto:a@b"),
    ],
)
def test_addresses(href, address):
    assert absolute_url(href, "https://b.com")[0] == address


def test_config_is_checked():
    assert MigrationConfig(post_status=" draft ").post_status == "draft"
    for bad in (
        {"workers": 0}, {"workers": 17}, {"rate_cap": 0}, {"backoff_multiplier": 0.5}, {"max_attempts": -1},
        {"category_order": "none"}, {"post_status": ""}, {"bookmark_selector": "a" * 201}, {"tag_selector": ""},
    ):
        with pytest.raises(ConfigurationError):
            MigrationConfig(**bad)

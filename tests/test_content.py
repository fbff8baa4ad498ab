import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkferry.config import MigrationConfig
from inkferry.operators import content, extract, media, previews, terms
from inkferry.operators.dom import Page
from inkferry.operators.skew import staged

BLOG = "https://example.blog.com"
CFG = MigrationConfig()


def pages(spark, *contents):
    rows = [
        (BLOG, f"{BLOG}/{n}", f'<meta name="title" content="Post {n}"><meta property="article:published_time" content="2024-01-15T10:00:00+09:00"><div class="tt_article_useless_p_margin contents_style">{c}</div>')
        for n, c in enumerate(contents)
    ]
    return spark.createDataFrame(rows, "blog_url string, url string, html string")


def clean(spark, source):
    return content.clean_content(pages(spark, source), CFG).first().content


def test_table_is_reduced_to_its_structure(spark):
    got = clean(spark, """<table class="t" style="width:100%" border="1" data-ke-align="left">
      <tr><th style="x">Header 1</th><th>Header 2</th></tr><tr><td style="x"> Data 1 </td><td>Data 2</td></tr></table>""")
    assert got == (
        "<table><thead><tr><th>Header 1</th><th>Header 2</th></tr></thead>"
        "<tbody><tr><td>Data 1</td><td>Data 2</td></tr></tbody></table>"
    )


def test_table_images_keep_source_and_size(spark):
    figure = '<figure class="imageblock"><span data-url="u"><img src="https://i/a.png?x=1&y=2&amp;z=3" loading="lazy" width="24" height=""></span></figure>'
    got = clean(spark, f"<table><tbody><tr><td>{figure}</td><td>Text</td></tr></tbody></table>")
    assert got == (
        '<table><tbody><tr><td><img src="https://i/a.png?x=1&amp;y=2&amp;z=3" width="24"></td><td>Text</td></tr></tbody></table>'
    )


def test_head_only_when_the_first_cell_is_th(spark):
    assert "<thead>" not in clean(spark, "<table><tr><td>a</td><th>b</th></tr></table>")


def test_inline_marks(spark):
    got = clean(spark, "<p>A <strong>s</strong>, <b>b</b>, <em>e</em>, <i>i</i> x<sup>2</sup> <sub class='k'>y</sub> <del>d</del> <span style='c'>w</span></p>")
    assert got == (
        "<p>A <strong>s</strong>, <strong>b</strong>, <em>e</em>, <em>i</em> x<sup>2</sup> "
        '<sub class="k">y</sub> <del>d</del> w</p>'
    )


def test_cards_stay_verbatim_and_are_marked(spark):
    card = '<figure class="bookmark-card"><div class="in"><a class="l" href="https://e" target="_blank"><img src="https://e/i.jpg" alt="T" /></a></div></figure>'
    got = clean(spark, card)
    assert got == f"<!-- wp:html -->{card.replace(' />', '>')}<!-- /wp:html -->"


def test_quote_and_video(spark):
    got = clean(spark, """<blockquote data-ke-style="s"><p>This is a quote.</p></blockquote>
      <figure data-ke-type="video" style="width: 320px;"><div class="player"><iframe src="https://player.example.net/v/77" width="400"
      height="225" frameborder="" allowfullscreen="true"></iframe></div><figcaption style="display: none;"></figcaption></figure><iframe width="1"></iframe>""")
    assert got == (
        "<blockquote>\n<p>This is a quote.</p>\n</blockquote>\n"
        '<iframe src="https://player.example.net/v/77" width="400" height="225" allowfullscreen="true"></iframe>'
    )


def test_lists_code_headings_and_wrappers(spark):
    got = clean(spark, """<h2 style="x">T <b>x</b></h2><ol start="3"><li>a</li><li><p>b</p></li></ol><ul><li><input type="checkbox" checked> done</li></ul>
<pre class="c"><code class="language-js hl">x &lt; 1
 y</code></pre><div>loose <span>text</span><div>in</div>after<br></div><p> </p><hr class="h"><p>a<br>b</p><script>var x</script>""")
    assert got == (
        '<h2>T <strong>x</strong></h2>\n<ol start="3">\n<li>a</li>\n<li><p>b</p></li>\n</ol>\n'
        '<ul>\n<li><input checked="" disabled="" type="checkbox"> done</li>\n</ul>\n'
        '<pre><code class="language-js">x &lt; 1\n y\n</code></pre>\n<p>loose text</p>\n<p>in</p>\n<p>after</p>\n<hr>\n<p>a<br>b</p>'
    )


def test_missing_content_is_empty(spark):
    frame = spark.createDataFrame([(BLOG, BLOG, "<p>x</p>")], "blog_url string, url string, html string")
    assert content.clean_content(frame, CFG).first().content == ""


def test_replaceable_halves(spark):
    @F.pandas_udf("string")
    def shout(texts: pd.Series) -> pd.Series:
        return texts.str.upper()

    frame = pages(spark, "<p class='c'>a &amp; <b>b</b></p>", "")
    run = lambda **halves: [r.content for r in content.clean_content(frame, CFG, **halves).orderBy("url").collect()]
    mark = lambda c: F.concat(c, F.lit("!"))
    assert run(to_markdown=shout) == ['<P CLASS="C">A &AMP; <B>B</B></P>', ""]
    assert run(to_markdown=shout, to_html=mark) == ['<P CLASS="C">A &AMP; <B>B</B></P>!', ""]
    assert run(to_html=mark) == ["<p>a &amp; <strong>b</strong></p>!", ""]


def fetched(spark, *rows):
    return spark.createDataFrame(rows, "url string, html string")


def preview(spark, source, url="https://e.com/a"):
    marks = spark.createDataFrame([(url,)], "bookmark_url string")
    return previews.preview_metadata(marks, fetched(spark, (url, source))).first()


def test_preview_fallbacks(spark):
    full = preview(spark, '<meta property="og:title" content="안녕 你好"><meta property="og:description" content="مرحبا"><meta property="og:image" content="https://i/x.jpg"><meta property="og:url" content="https://other">')
    assert (full.title, full.description, full.image, full.url, full.error) == ("안녕 你好", "مرحبا", "https://i/x.jpg", "https://e.com/a", None)
    plain = preview(spark, "<title>Fallback Title</title>")
    assert (plain.title, plain.description, plain.image) == ("Fallback Title", None, None)
    icon = preview(spark, '<meta property="og:title" content=""><link rel="apple-touch-icon" href="t.png"><link rel="icon" href="/i.png">')
    assert (icon.title, icon.image) == ("https://e.com/a", "https://e.com/i.png")
    failed = preview(spark, None)
    assert (failed.title, failed.description, failed.image) == ("https://e.com/a", None, None) and failed.error


def card(spark, **values):
    row = [{"title": None, "description": None, "image": None, "url": "https://e.com"} | values]
    frame = spark.createDataFrame(row, "url string, title string, description string, image string")
    return previews.preview_cards(frame).select("value.*").first()


def test_card_parts(spark):
    full = card(spark, title="Example {url}", description="Short", image="https://e/i.jpg?a&b")
    assert full.card.startswith('<figure class="bookmark-card" style="border: 1px solid')
    for piece in (
        '<a class="bookmark-overlay-link" href="https://e.com" target="_blank" rel="noopener noreferrer" aria-label="Example {url}"',
        'class="bookmark-row" style="display: flex;', "min-height: 80px", "flex: 0 0 30%", "flex: 1",
        'src="https://e/i.jpg?a&amp;b" alt="Example {url}"', ">Short</p>",
    ):
        assert piece in full.card
    bare = card(spark, title=" ")
    assert "https://e.com\n" in bare.card and "<img" not in bare.card and "bookmark-description" not in bare.card
    assert 'class="bookmark-featured-image"' in bare.card


def test_card_escapes_markup(spark):
    got = card(spark, title="<b onclick='f()'>5 > 3</b>", description='<form action="/x">"a" & b</form>').card
    assert "<b " not in got and "<form" not in got
    assert "&lt;b onclick=&#039;f()&#039;&gt;5 &gt; 3&lt;/b&gt;" in got and "&quot;a&quot; &amp; b" in got


@pytest.mark.parametrize("values", [{}, {"title": "T"}, {"title": "A title", "description": "About", "image": "https://i"}])
def test_card_context_is_the_text_of_the_card(spark, values):
    got = card(spark, **values)
    assert got.context == Page(got.card).elements[0].text()[:50].strip()


MARK = '<figure data-ke-type="opengraph"><a href="{}">x</a></figure>'


def replaced(spark, *contents, known=()):
    posts = extract.parse_posts(pages(spark, *contents), CFG)
    shown = previews.preview_metadata(extract.bookmarks(posts), fetched(spark, *known) if known else fetched(spark, ("none", "")))
    return content.replace_bookmarks(posts, shown)


def test_bookmarks_become_cards(spark, all_hot):
    a, b = "https://e.com/a", "https://e.com/b"
    known = [(u, f'<meta property="og:title" content="Title for {u}">') for u in (a, b)]
    got = replaced(
        spark,
        f"<p>Intro</p>{MARK.format(a)}<p>between</p>{MARK.format(b)}{MARK.format(a)}",
        "<p>No bookmarks</p>",
        '<figure data-ke-type="opengraph"><a>missing</a></figure>',
        MARK.format("https://e.com/gone"),
        known=known,
    )
    html = {r.url[-1]: r.html for r in got.select("url", content.joined(F.col("segments")).alias("html")).collect()}
    assert html["0"].count('class="bookmark-card"') == 3 == html["0"].count("<!-- wp:html --><figure")
    assert html["0"].index(f"Title for {a}") < html["0"].index("<p>between</p>") < html["0"].index(f"Title for {b}")
    assert html["1"] == "<p>No bookmarks</p>"
    assert html["2"] == "<p>missing</p>"
    assert 'href="https://e.com/gone"' in html["3"] and "src=" not in html["3"]


def test_copies_of_a_page_stay_apart(spark, all_hot):
    frame = pages(spark, MARK.format("https://e.com/a"), MARK.format("https://e.com/b"))
    frame = frame.withColumn("url", F.lit(f"{BLOG}/same"))
    frame = frame.unionByName(frame)
    posts = staged(extract.parse_posts(frame, CFG), "posts")
    known = [(f"https://e.com/{n}", f"<title>T{n}</title>") for n in "aab"] + [("https://e.com/a", "<title>S</title>")]
    shown = previews.preview_metadata(extract.bookmarks(posts), fetched(spark, *known))
    assert shown.count() == 2
    html = [r.html for r in content.replace_bookmarks(posts, shown).select(content.joined(F.col("segments")).alias("html")).collect()]
    assert sorted('e.com/a"' in h for h in html) == [False, False, True, True] and all(h.count("<figure") == 1 for h in html)


def test_card_links_count_as_internal(spark):
    target = f"{BLOG}/7"
    got = replaced(spark, f'<p>a <a href="/1">one</a></p>{MARK.format(target)}', known=[(target, "<title>Seven</title>")])
    rows = extract.internal_links(got).orderBy("pos").collect()
    assert [(r.target_url, r.link_text) for r in rows] == [(f"{BLOG}/1", "one"), (target, "")]
    assert rows[1].context == "Seven"


def test_images_are_rewritten_and_listed(spark):
    source = (
        '<p><img src="https://i/1.jpg" alt="first"></p><figure class="bookmark-card"><img src="https://i/c.jpg"></figure>'
        '<p><img src="https://i/2.png"></p><p><img src="https://i/1.jpg"></p>'
    )
    posts = extract.parse_posts(pages(spark, source), CFG).withColumn("job_item_id", F.lit(5).cast("bigint"))
    assets = spark.createDataFrame(
        [
            (1, 5, "https://i/1.jpg", "uploaded", 100, "https://d/old.jpg"),
            (2, 5, "https://i/1.jpg", "uploaded", 101, "https://d/1.jpg?a=1&b=2"),
            (3, 5, "https://i/2.png", "failed", None, None),
            (4, 6, "https://i/2.png", "uploaded", 103, "https://d/2.png"),
            (5, 5, "https://i/c.jpg", "uploaded", 104, "https://d/c.jpg"),
        ],
        "id long, job_item_id long, image_url string, status string, dest_media_id long, dest_media_url string",
    )
    got = content.rewrite_images(posts, assets).withColumn("html", content.joined(F.col("segments"))).first()
    assert got.html.count('src="https://d/1.jpg?a=1&amp;b=2"') == 2
    assert 'src="https://i/c.jpg"' in got.html and 'src="https://i/2.png"' in got.html
    assert [(i.pos, i.url, i.alt_text, i.media_id) for i in got.images] == [
        (0, "https://i/1.jpg", "first", 101), (2, "https://i/1.jpg", "", 101),
    ]


def test_visible_text_is_kept(spark):
    source = "<p>One <b>two</b></p><script>no()</script><ul><li>three<ul><li>four</li></ul></li></ul><table><tr><td>five</td></tr></table><pre><code>six\n seven</code></pre><div>eight<p>nine</p>ten</div>"
    got = content.content_retention(pages(spark, source), CFG).first()
    assert got.chars_before == got.chars_after == len("Onetwothreefourfivesixseveneightnineten") and got.kept == 1.0


def test_media_plan_and_names(spark):
    posts = spark.createDataFrame(
        [("u1", "Test Post: One & Two!", "https://f", [(0, "https://i/1", None), (1, "https://i/1", "x")]), ("u2", "한글", None, [(0, "https://i/1", None)])],
        "url string, title string, featured_image_url string, images array<struct<pos int, url string, alt_text string>>",
    )
    mimes = spark.createDataFrame([("https://i/1", "image/jpeg"), ("https://f", "image/png; charset=x")], "image_url string, mime string")
    got = {(r.url, r.pos): r for r in media.media_plan(posts, mimes).collect()}
    assert got["u1", -1].alt_text == "Featured image for Test Post: One & Two!"
    assert got["u1", -1].file_name == "test-post-one-t-image.bin"
    assert got["u1", 1].file_name == "test-post-one-t-image.jpg" and got["u2", 0].file_name == "-image.jpg"
    once = media.media_plan(posts, mimes, dedupe=True).collect()
    assert sorted((r.url, r.pos, r.image_url) for r in once) == [("u1", -1, "https://f"), ("u1", 0, "https://i/1")]


def test_rollback_order_and_orphans(spark):
    log = spark.createDataFrame([(1, "failed", 900), (2, "failed", None), (3, "completed", 901)], "id long, status string, dest_post_id long")
    assets = spark.createDataFrame(
        [
            (10, 1, "f", "uploaded", 50), (11, 1, "a", "uploaded", 51), (12, 1, "b", "failed", None), (13, 1, "c", "uploaded", None),
            (14, 2, "d", "uploaded", 54), (15, 3, "e", "uploaded", 55),
        ],
        "id long, job_item_id long, image_url string, status string, dest_media_id long",
    )
    featured = spark.createDataFrame([(1, "f")], "job_item_id long, image_url string")
    plan = media.rollback_plan(log, assets, featured).orderBy("job_item_id", "step", "asset_id").collect()
    assert [(r.job_item_id, r.step, r.kind, r.target_id) for r in plan] == [
        (1, 1, "media", 50), (1, 2, "media", 51), (1, 3, "post", 900), (2, 2, "media", 54),
    ]
    assert [r.id for r in media.orphaned_media(assets, log, featured).collect()] == [11]


def test_terms_and_payloads(spark):
    posts = spark.createDataFrame(
        [
            (1, "u1", "T", "<p>", [(0, "Dev", None), (1, "Java", "Dev")], [(0, "js"), (1, "x"), (2, "js")], "2024-01-15 01:00:00"),
            (2, "u2", "T", "", [(0, "New", None)], [], None),
        ],
        "n long, url string, title string, content string, categories array<struct<pos int, name string, parent_name string>>, "
        "tags array<struct<pos int, name string>>, at string",
    ).withColumns(
        {
            "publish_date": F.col("at").cast("timestamp"),
            "publish_date_invalid": F.col("at").isNull(),
            "blog_url": F.lit("https://a"),
            "featured_image_url": F.lit(None).cast("string"),
            "parse_error": F.lit(None).cast("string"),
        }
    )
    existing = spark.createDataFrame(
        [("category", 7, "Java", 3), ("category", 5, "java", 0), ("tag", 20, "js", 0), ("tag", 9, "js", 0)],
        "taxonomy string, id long, name string, parent long",
    )
    found = terms.ensure_terms(posts, existing, order="n")
    got = {(r.taxonomy, r.name): (r.id, r.is_new, r.parent_id) for r in found.collect()}
    assert got == {
        ("category", "Dev"): (21, True, 0), ("category", "Java"): (7, False, 0), ("tag", "x"): (22, True, 0),
        ("tag", "js"): (9, False, 0), ("category", "New"): (23, True, 0),
    }
    featured = spark.createDataFrame([("u1", 0)], "url string, featured_media long")
    payloads, errors = terms.build_payloads(posts, found, "draft", featured, id_columns=("url",))
    row = payloads.first()
    assert (row.categories, row.tags, row.date, row.status) == ([21, 7], [9, 22, 9], "2024-01-15T01:00:00.000Z", "draft")
    assert row.featured_media is None
    assert [(e.url, e.message) for e in errors.collect()] == [("u2", "Invalid time value")]
    broken = posts.withColumn("parse_error", F.when(F.col("url") == "u2", "KeyError: x"))
    _, errors = terms.build_payloads(broken, found, "draft", featured, id_columns=("url",))
    assert [(e.url, e.message) for e in errors.collect()] == [("u2", "KeyError: x")]


def test_odd_markup_loses_neither_post_nor_text(spark):
    assert clean(spark, '<p>a<sup><img alt="x"></sup>b</p>') == '<p>a<sup><img alt="x"></sup>b</p>'
    assert "keep me" in clean(spark, "<p>x</p><textarea>keep me</textarea>")
    assert clean(spark, '<table><tr><td><img src="">t</td></tr></table>') == "<table><tbody><tr><td>t</td></tr></tbody></table>"

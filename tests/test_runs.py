from pyspark.sql import functions as F

from inkferry.config import MigrationConfig
from inkferry.operators import extract, history
from inkferry.plans import runs

A = "https://a.blog.com"
CFG = MigrationConfig(rate_cap=2)


def test_full_run_skips_attempted_posts(spark):
    html = "".join(f'<a class="link_category" href="/{n}">p</a>' for n in (3, 1, 2))
    list_pages = spark.createDataFrame([(A, 1, html)], "blog_url string, page_no long, html string")
    jobs = spark.createDataFrame([(1, A)], "id long, blog_url string")
    items = spark.createDataFrame(
        [(1, 1, f"{A}/1", "running"), (2, 1, f"{A}/9", "failed"), (3, 1, f"{A}/8", "failed")],
        "id long, job_id long, post_url string, status string",
    )
    plan, skipped = runs.plan_full_run(list_pages, items, jobs, CFG)
    rows = plan.orderBy("n").collect()
    assert [(r.post_url, r.slot) for r in rows] == [(f"{A}/3", 0), (f"{A}/2", 0)]
    assert [tuple(r) for r in skipped.collect()] == [(A, 1)]
    retry = runs.plan_retry_run(items, jobs, CFG).orderBy("n").collect()
    assert [r.post_url for r in retry] == [f"{A}/8", f"{A}/9"]
    pages = spark.createDataFrame([(A, f"{A}/{n}", "") for n in range(5)], "blog_url string, url string, html string")
    assert sorted(r.url for r in runs.pages_to_run(pages, plan).collect()) == [f"{A}/2", f"{A}/3"]
    attempted = {r.post_url for r in history.attempted_urls(items, jobs).collect()}
    assert attempted.isdisjoint(r.post_url for r in rows)


def test_posts_pass_through_the_stages_in_order(spark):
    source = (
        '<meta name="title" content="T"><div class="tt_article_useless_p_margin contents_style"><p>in</p>'
        '<figure data-ke-type="opengraph"><a href="https://e.com/x">b</a></figure><p><img src="https://i/1"></p></div>'
    )
    pages = spark.createDataFrame([(A, f"{A}/1", source)], "blog_url string, url string, html string")
    fetched = spark.createDataFrame(
        [("https://e.com/x", '<title>E</title><meta property="og:image" content="https://e.com/i.png">')], "url string, html string"
    )
    post = runs.finished_content(runs.assemble_posts(pages, fetched, CFG))
    row = post.first()
    assert row.content.startswith('<p>in</p>\n<!-- wp:html --><figure class="bookmark-card"')
    assert row.content.endswith('<!-- /wp:html -->\n<p><img src="https://i/1" alt=""></p>')
    # images of cards are not moved
    assert [i.image_url for i in extract.post_images(post).collect()] == ["https://i/1"]

    stages = runs.post_stages(CFG, fetched)
    shout = lambda posts: posts.withColumn("title", F.upper(F.concat("title", F.lit("!"))))
    assert runs.run_stages(pages, [stages[0], shout, stages[1]]).first().title == "T!"

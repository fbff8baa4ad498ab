"""Input tables derived from the given test tables; the same SQL runs in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The words of a page's whole HTML. EVERY stands for the oracle's flag; in Spark it is a comment.
EVERY = "/* every match */"
PAGE_WORDS = f"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' '{EVERY}), '[^A-Za-z0-9]+', ' '{EVERY}))"

VIEWS = {
    "job_items": """
SELECT event_id + 1 AS id,
  CAST(FLOOR(event_id / 100) AS BIGINT) + 1 AS job_id,
  concat('https://blog-', CAST((CAST(FLOOR(event_id / 100) AS BIGINT) + 1) % 4 AS VARCHAR(9)), '.example.com/',
         CAST(user_id * 10 + event_id % 10 AS VARCHAR(20))) AS post_url,
  CASE WHEN event_type IN ('purchase', 'signup') THEN event_id + 100000 END AS dest_post_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'completed'
       WHEN event_type IN ('error', 'click') THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN event_type IN ('error', 'click') THEN
    CASE event_id % 4 WHEN 0 THEN 'HTTP 500' WHEN 1 THEN 'HTTP 429 Too Many Requests'
                      WHEN 2 THEN 'timeout of 60000ms exceeded' END END AS error_message,
  ts AS created_at, ts AS updated_at
FROM events""",
    "post_jobs": """
SELECT job_id AS id,
  concat('https://blog-', CAST(job_id % 4 AS VARCHAR(9)), '.example.com') AS blog_url,
  CASE job_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'retry' ELSE 'single' END AS job_type,
  CASE WHEN SUM(CASE WHEN status = 'running' THEN 1 ELSE 0 END) > 22 THEN 'running'
       WHEN SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) > 0 THEN 'failed'
       ELSE 'completed' END AS status,
  MIN(created_at) AS created_at
FROM job_items GROUP BY job_id""",
    "image_assets": """
SELECT event_id + 1 AS id,
  CAST(FLOOR(event_id / 3) AS BIGINT) + 1 AS job_item_id,
  concat('https://img.example.com/', CAST((user_id * 7 + event_id % 5) % 500 AS VARCHAR(9)), '.jpg') AS image_url,
  CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'uploaded' END AS status,
  CASE WHEN event_id % 7 > 1 THEN event_id + 500000 END AS dest_media_id,
  ts AS created_at, ts AS updated_at
FROM events""",
    "featured_of_item": """
SELECT job_item_id, MIN(image_url) AS image_url FROM image_assets GROUP BY job_item_id""",
    "post_map": """
SELECT MIN(id) AS id, post_url, MIN(dest_post_id) AS dest_post_id, MIN(updated_at) AS created_at
FROM job_items WHERE status = 'completed' GROUP BY post_url""",
    "internal_links": """
SELECT event_id + 1 AS id,
  CAST(FLOOR(event_id / 2) AS BIGINT) + 1 AS job_item_id,
  concat('https://blog-', CAST(user_id % 4 AS VARCHAR(9)), '.example.com/', CAST(user_id * 10 AS VARCHAR(20))) AS source_url,
  concat('https://blog-', CAST((CAST(FLOOR(event_id / 100) AS BIGINT) + 1) % 4 AS VARCHAR(9)), '.example.com/',
         CAST(CASE WHEN event_id % 3 = 0 THEN 80 ELSE user_id * 10 + event_id % 7 END AS VARCHAR(20))) AS target_url,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('next "post" 글 ', CAST(user_id AS VARCHAR(9))) END AS link_text,
  CASE event_id % 4 WHEN 0 THEN NULL ELSE concat('see <b> & ', CAST(event_id % 10 AS VARCHAR(9))) END AS context,
  ts AS created_at
FROM events""",
    "item_patches": """
SELECT CAST(FLOOR(event_id / 2) AS BIGINT) + 1 AS id, event_id AS seq, 'status' AS field,
  CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS value
FROM events WHERE event_type <> 'view'
UNION ALL
SELECT user_id + 1 AS id, event_id AS seq, 'error_message' AS field,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('patched ', CAST(event_id AS VARCHAR(20))) END AS value
FROM events
UNION ALL
SELECT event_id + 1 AS id, event_id AS seq, 'dest_post_id' AS field, CAST(event_id + 900000 AS VARCHAR(20)) AS value
FROM events WHERE event_type = 'error'""",
    "job_patches": """
SELECT CAST(FLOOR(event_id / 100) AS BIGINT) + 1 AS id, event_id AS seq, 'status' AS field,
  CASE event_id % 2 WHEN 0 THEN 'completed' ELSE 'failed' END AS value
FROM events WHERE event_id % 50 = 7
UNION ALL
SELECT CAST(FLOOR(event_id / 100) AS BIGINT) + 1 AS id, event_id AS seq, 'error_message' AS field,
  CASE WHEN event_id % 4 = 0 THEN concat('job ', CAST(event_id AS VARCHAR(20))) END AS value
FROM events WHERE event_id % 30 = 2""",
    "asset_patches": """
SELECT event_id + 1 AS id, event_id AS seq, 'dest_media_id' AS field, CAST(event_id + 800000 AS VARCHAR(20)) AS value
FROM events WHERE event_id % 7 = 1
UNION ALL
SELECT event_id + 1 AS id, event_id AS seq, 'status' AS field, 'uploaded' AS value
FROM events WHERE event_id % 7 = 1
UNION ALL
SELECT event_id + 1 AS id, event_id AS seq, 'dest_media_url' AS field,
  CASE WHEN event_id % 2 = 0 THEN concat('https://dest.example.com/', CAST(event_id AS VARCHAR(20))) END AS value
FROM events WHERE event_id % 5 = 3""",
    "broken_post_jobs": """
SELECT id, CASE WHEN id % 11 = 3 THEN NULL ELSE blog_url END AS blog_url,
  CASE WHEN id % 13 = 4 THEN 'double' WHEN id % 17 = 5 THEN NULL ELSE job_type END AS job_type,
  CASE WHEN id % 19 = 6 THEN 'paused' WHEN id % 23 = 7 THEN NULL ELSE status END AS status,
  CASE WHEN id % 7 = 2 THEN NULL ELSE created_at END AS created_at
FROM post_jobs WHERE job_type <> 'single'""",
    "broken_job_items": """
SELECT id, CASE WHEN id % 101 = 1 THEN NULL ELSE job_id END AS job_id, CASE WHEN id % 103 = 2 THEN NULL ELSE post_url END AS post_url,
  CASE WHEN id % 107 = 3 THEN 'lost' WHEN id % 109 = 4 THEN NULL ELSE status END AS status,
  CASE WHEN id % 113 = 5 THEN NULL ELSE created_at END AS created_at, CASE WHEN id % 127 = 6 THEN NULL ELSE updated_at END AS updated_at
FROM job_items WHERE id % 40 <> 0""",
    "broken_image_assets": """
SELECT id, CASE WHEN id % 101 = 1 THEN NULL ELSE job_item_id END AS job_item_id, CASE WHEN id % 103 = 2 THEN NULL ELSE image_url END AS image_url,
  CASE WHEN image_url LIKE '%9.jpg' THEN 'lost' WHEN id % 109 = 4 THEN NULL ELSE status END AS status,
  CASE WHEN id % 113 = 5 THEN NULL ELSE created_at END AS created_at, CASE WHEN id % 127 = 6 THEN NULL ELSE updated_at END AS updated_at
FROM image_assets""",
    "broken_internal_links": """
SELECT id, CASE WHEN id % 101 = 1 THEN NULL ELSE job_item_id END AS job_item_id, CASE WHEN id % 103 = 2 THEN NULL ELSE source_url END AS source_url,
  CASE WHEN id % 107 = 3 THEN NULL ELSE target_url END AS target_url, CASE WHEN id % 113 = 5 THEN NULL ELSE created_at END AS created_at
FROM internal_links""",
    "broken_map": """
SELECT id, CASE WHEN id % 31 = 8 THEN NULL ELSE post_url END AS post_url,
  CASE WHEN id % 29 = 3 THEN NULL ELSE CAST(FLOOR(dest_post_id / 4) AS BIGINT) END AS dest_post_id,
  CASE WHEN id % 37 = 9 THEN NULL ELSE created_at END AS created_at
FROM job_items WHERE status = 'completed'""",
    "posts_raw": """
SELECT page_id,
  concat('https://blog-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com') AS blog_url,
  concat('https://blog-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com/', CAST(page_id AS VARCHAR(9))) AS url,
  concat('<html><head>',
    CASE WHEN page_id % 10 = 0 THEN '' WHEN page_id % 10 = 1 THEN '<meta name="title" content="">'
         ELSE concat('<meta name="title" content="  Post &amp; 글 ', CAST(page_id AS VARCHAR(9)), ' ">') END,
    CASE WHEN page_id % 17 = 0 THEN '<meta property="article:published_time" content="not-a-date">'
         ELSE concat('<meta property="article:published_time" content="2024-01-', lpad(CAST(1 + page_id % 28 AS VARCHAR(9)), 2, '0'), 'T10:00:00+09:00">') END,
    CASE WHEN page_id % 3 = 0 THEN '<meta property="article:modified_time" content="2024-02-01T00:00:00Z">' ELSE '' END,
    '</head><body><div id="main"><div><div><div class="article_header type_article_header_cover">',
    CASE page_id % 4 WHEN 0 THEN concat('<div style="background-image: url(&quot;https://img.example.com/f', CAST(page_id AS VARCHAR(9)), '.jpg&quot;);"></div>')
      WHEN 1 THEN concat('<div style="background-image:url(', chr(39), '/images/f', CAST(page_id AS VARCHAR(9)), '.jpg', chr(39), ')"></div>')
      WHEN 2 THEN '<div style="color: red"></div>' ELSE '' END,
    '</div></div></div></div><div class="another_category">',
    CASE WHEN page_id % 4 >= 1 THEN concat('<h4><a href="/category/a"> Cat ', CAST(page_id % 5 AS VARCHAR(9)), ' </a></h4>') ELSE '' END,
    CASE WHEN page_id % 4 >= 2 THEN concat('<h4><a href="/category/b">개발 ', CAST(page_id % 3 AS VARCHAR(9)), '</a></h4>') ELSE '' END,
    CASE WHEN page_id % 4 >= 3 THEN '<h4><a href="/category/c">Third</a></h4>' ELSE '' END,
    '</div><div class="tt_article_useless_p_margin contents_style"><p style="color:red">Body <b>bold</b> <i>it</i> <sup>2</sup> see <a href="/',
    CAST(page_id + 1 AS VARCHAR(9)), '">next post</a> and <a href="https://other.example.org/x">ext</a> <a href="mailto:a@b.c">m</a> <a href="#frag">f</a></p>',
    CASE WHEN page_id % 2 = 0 THEN concat('<figure data-ke-type="opengraph"><a href="https://site-', CAST(page_id % 50 AS VARCHAR(9)), '.example.org/a">bm</a></figure>') ELSE '' END,
    CASE WHEN page_id % 3 >= 1 THEN concat('<figure class="imageblock"><span><img src="https://img.example.com/', CAST(page_id % 40 AS VARCHAR(9)), '.jpg" alt="one" loading="lazy"></span></figure>') ELSE '' END,
    CASE WHEN page_id % 3 >= 2 THEN '<table border="1"><tr><th style="x">H</th></tr><tr><td>1<img src="https://img.example.com/t.png?a=1&amp;b=2" width="5"></td></tr></table>' ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN '<iframe src="https://player.example.net/v/1" width="400" height="225" frameborder="0" allowfullscreen="true"></iframe>' ELSE '' END,
    '<p class="page">', {PAGE_WORDS}, '</p></div><div class="area_tag"><a href="/tag/t" rel="tag">Tag', CAST(page_id % 11 AS VARCHAR(9)), '</a><a href="/tag/n" rel="tag">Node.js</a></div></body></html>') AS html
FROM pages""".replace("{PAGE_WORDS}", PAGE_WORDS),
    "post_uploads": """
SELECT page_id * 2 + 1 AS id, page_id + 1 AS job_item_id,
  concat('https://img.example.com/', CAST(page_id % 40 AS VARCHAR(9)), '.jpg') AS image_url,
  CASE WHEN page_id % 5 = 0 THEN 'failed' ELSE 'uploaded' END AS status,
  page_id + 700000 AS dest_media_id,
  concat('https://dest.example.com/m?p=', CAST(page_id AS VARCHAR(9)), '&s=1') AS dest_media_url
FROM pages
UNION ALL
SELECT page_id * 2 + 2 AS id, page_id + 1 AS job_item_id, 'https://img.example.com/t.png?a=1&b=2' AS image_url,
  CASE WHEN page_id % 2 = 0 THEN 'pending' ELSE 'uploaded' END AS status,
  page_id + 800000 AS dest_media_id,
  concat('https://dest.example.com/t/', CAST(page_id AS VARCHAR(9)), '.png') AS dest_media_url
FROM pages""",
    "fetched_pages": """
SELECT concat('https://site-', CAST(s AS VARCHAR(9)), '.example.org/a') AS url,
  concat('<html><head>',
    CASE WHEN s % 10 IN (0, 2) THEN concat('<meta property="og:title" content="OG ', CAST(s AS VARCHAR(9)), '"><meta property="og:description" content="D &lt;b&gt;">') ELSE '' END,
    CASE WHEN s % 10 = 0 THEN '<meta property="og:image" content="https://cdn.example.org/og.png">' ELSE '' END,
    CASE WHEN s % 10 IN (2, 4) THEN '<link rel="shortcut icon" href="favicon.ico">' ELSE '' END,
    CASE WHEN s % 10 IN (2, 4) THEN concat('<title>T ', CAST(s AS VARCHAR(9)), '</title>') ELSE '' END,
    '</head></html>') AS html
FROM (SELECT DISTINCT page_id % 50 AS s FROM pages WHERE page_id % 2 = 0) t WHERE s % 10 <> 8""",
    "list_pages": """
SELECT blog_url, page_no, CASE WHEN k < 3 AND page_no = 6 + 2 * k THEN '<html><body><p>No posts.</p></body></html>' ELSE html END AS html
FROM (SELECT page_id % 4 AS k, concat('https://blog-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com') AS blog_url,
             CAST(FLOOR(page_id / 4) AS BIGINT) + 1 AS page_no, html FROM pages) t
WHERE NOT (k = 3 AND page_no = 10)""",
    "crawl_items": """
SELECT page_id + 1 AS id, 4 + page_id % 4 AS job_id,
  concat('https://blog-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com',
         regexp_extract(html, '<li><a href="([^"]*)"', 1)) AS post_url,
  'failed' AS status
FROM pages""",
    "outcomes": """
SELECT CASE WHEN id % 101 = 0 THEN id + 1000000000 ELSE id END AS id, id AS seq,
  CASE WHEN id % 97 = 0 THEN 'paused' ELSE status END AS status,
  CASE WHEN id % 89 = 0 THEN NULL ELSE dest_post_id END AS dest_post_id, error_message
FROM job_items WHERE status IN ('completed', 'failed') AND job_id % 3 <> 0""",
    "messages": """
SELECT error_message FROM job_items WHERE status = 'failed'
UNION ALL
SELECT value AS error_message FROM item_patches WHERE field = 'error_message'
UNION ALL
SELECT concat('  blog ', CAST(event_id % 4 AS VARCHAR(9)), ' answered ', CAST(500 + event_id % 3 AS VARCHAR(9)), ' for post ',
  CAST(event_id AS VARCHAR(20))) AS error_message FROM events""",
    "moved_posts": """
SELECT concat('https://blog-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com/older/', CAST(page_id AS VARCHAR(9))) AS from_url,
  concat('http://BLOG-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com:80/old/', CAST(page_id AS VARCHAR(9)), '/') AS to_url FROM pages
UNION ALL
SELECT concat('https://blog-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com/old/', CAST(page_id AS VARCHAR(9)), '?') AS from_url,
  concat('https://blog-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com/', CAST(page_id AS VARCHAR(9))) AS to_url FROM pages
WHERE page_id % 7 <> 0""",
    "moved_map": """
SELECT page_id + 1 AS id, concat('https://blog-', CAST(page_id % 4 AS VARCHAR(9)), '.example.com/', CAST(page_id AS VARCHAR(9))) AS post_url,
  page_id + 600000 AS dest_post_id FROM pages WHERE page_id % 5 <> 0""",
    "moved_links": """
SELECT page_id * 8 + k AS id, page_id AS target, k,
  concat(CASE k WHEN 1 THEN 'http://' WHEN 2 THEN 'HTTPS://' ELSE 'https://' END,
    CASE WHEN k = 2 THEN 'Blog-' ELSE 'blog-' END, CAST(page_id % 4 AS VARCHAR(9)), '.example.com',
    CASE WHEN k = 2 THEN ':443' ELSE '' END, CASE k WHEN 5 THEN '/old/' WHEN 6 THEN '/older/' ELSE '/' END,
    CAST(page_id AS VARCHAR(9)), CASE k WHEN 3 THEN '/' WHEN 4 THEN '#top' WHEN 5 THEN '?' WHEN 6 THEN '//#x' WHEN 7 THEN '/more' ELSE '' END) AS target_url
FROM pages CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS kinds(k)""",
    "existing_terms": """
SELECT taxonomy, CAST(id AS BIGINT) AS id, name, CAST(parent AS BIGINT) AS parent
FROM (VALUES ('category', 10, 'Cat 1', 0), ('category', 12, 'cat 2', 0), ('category', 7, 'Cat 3', 0),
  ('category', 15, 'Cat 3', 7), ('tag', 30, 'Node.js', 0), ('tag', 31, 'Tag', 0)) AS t(taxonomy, id, name, parent)""",
}
NEEDS = {
    "post_jobs": ("job_items",),
    "post_map": ("job_items",),
    "featured_of_item": ("image_assets",),
    "broken_post_jobs": ("job_items", "post_jobs"),
    "broken_job_items": ("job_items",),
    "broken_image_assets": ("image_assets",),
    "broken_internal_links": ("internal_links",),
    "broken_map": ("job_items",),
    "outcomes": ("job_items",),
    "messages": ("job_items", "item_patches"),
}


def ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for needed in (*NEEDS.get(name, ()), name):
            if needed not in out:
                out.append(needed)
    return out


def with_views(names: str, select: str, extra: str = "") -> str:
    """The select as one statement, with the named views in front as CTEs."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in ordered(tuple(names.split()))]
    if extra:
        ctes.append(extra)
    return f"WITH {', '.join(ctes)}\n{select}" if ctes else select


class Tables:
    """The given tables and the views derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        texts = [VIEWS[n] for n in ordered((name,))]
        used = [b for b in ("events", "pages") if any(f"FROM {b}" in text for text in texts)]
        return self.select(name, **{b: self.read(b) for b in used})

    def select(self, name: str, **bases: DataFrame) -> DataFrame:
        """A view over the given tables, which are bound to this statement alone."""
        text = with_views(name, f"SELECT * FROM {name}")
        for base in bases:
            text = text.replace(f"FROM {base}", f"FROM {{{base}}}")
        return self.spark.sql(text, **bases)

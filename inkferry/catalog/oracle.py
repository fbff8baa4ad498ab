"""Oracle SQL per query.

Posts are checked by arithmetic on `page_id`: every feature of their HTML follows from it, so the
oracle needs no HTML parser.
"""

from __future__ import annotations

from inkferry.catalog.fixtures import EVERY, PAGE_WORDS, VIEWS, with_views

ORACLE: dict[str, str] = {}

TRIM = r"'^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$'"


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, {TRIM}, '', 'g')"


def oracle(name: str, views: str, select: str, *ctes: str) -> None:
    ORACLE[name] = with_views(views, select, ", ".join(ctes)).replace(EVERY, ", 'g'")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, values: dict[str, str]) -> str:
    """A layout with {names} as a SQL expression."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [quoted(before), values[name]]
    return f"concat({', '.join([*parts, quoted(rest)])})"


def escaped(column: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        column = f"replace({column}, {quoted(raw)}, {quoted(safe)})"
    return column


# --- sources, sinks, text ---

oracle("raw_pages", "", f"SELECT 'https://blog.example.com' AS blog_url, regexp_replace(url, '^https?://[^/]+/', 'https://blog.example.com/') AS url, {trimmed('html')} AS html FROM pages")
oracle(
    "export_links",
    "internal_links job_items post_jobs",
    """SELECT i.job_id, j.blog_url, l.id AS ord, concat('{"source_url":', to_json(source_url), ',"target_url":', to_json(target_url),
  CASE WHEN link_text IS NULL THEN '' ELSE concat(',"link_text":', to_json(link_text)) END,
  CASE WHEN context IS NULL THEN '' ELSE concat(',"context":', to_json(context)) END, '}') AS item
FROM internal_links l JOIN job_items i ON l.job_item_id = i.id JOIN post_jobs j ON j.id = i.job_id""",
)
TAGGED = "tagged AS (SELECT i.*, j.blog_url FROM job_items i JOIN post_jobs j ON i.job_id = j.id)"
STATES = (
    "states AS (SELECT blog_url, post_url, COUNT(*) AS attempts, "
    "SUM(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS done, "
    "SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS bad FROM tagged GROUP BY blog_url, post_url)"
)
OPEN = (
    "open_failures AS (SELECT * FROM tagged f WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM tagged c "
    "WHERE c.blog_url = f.blog_url AND c.post_url = f.post_url AND c.status = 'completed'))"
)
MESSAGES = """messages AS (SELECT blog_url, post_url, error_message, MIN(id) AS seen, COALESCE(error_message, '') <> '' AS worded,
  MIN(MIN(id)) OVER (PARTITION BY blog_url, post_url) AS first_id, bool_or(COALESCE(error_message, '') <> '') OVER (PARTITION BY blog_url, post_url) AS any_worded
FROM open_failures GROUP BY blog_url, post_url, error_message)"""
LOG = "job_items post_jobs"
LINK_ITEM = """concat('{"source_url":', to_json(source_url), ',"target_url":', to_json(target_url),
  CASE WHEN link_text IS NULL THEN '' ELSE concat(',"link_text":', to_json(link_text)) END,
  CASE WHEN context IS NULL THEN '' ELSE concat(',"context":', to_json(context)) END, '}')"""
oracle(
    "links_document",
    "internal_links job_items post_jobs",
    """SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, concat('{"blog_url":"', (SELECT blog_url FROM post_jobs WHERE id = 2),
  '","exported_at":"2024-06-01T00:00:00.000Z","count":', (SELECT COUNT(*) FROM entries), ',"items":[') AS line
UNION ALL SELECT 1, id, concat(CASE WHEN id = (SELECT MIN(id) FROM entries) THEN '' ELSE ',' END, item) FROM entries
UNION ALL SELECT 2, 0, ']}'""",
    f"entries AS (SELECT l.id, {LINK_ITEM} AS item FROM internal_links l JOIN job_items i ON l.job_item_id = i.id WHERE i.job_id = 2)",
)
oracle(
    "failed_posts_report",
    LOG,
    """SELECT blog_url, post_url, first_id AS ord, CASE WHEN worded THEN row_number() OVER (PARTITION BY blog_url, post_url, worded ORDER BY seen) ELSE 0 END AS n,
  CASE WHEN worded THEN error_message END AS error_message
FROM messages WHERE worded OR NOT any_worded""",
    TAGGED,
    OPEN,
    MESSAGES,
)
oracle(
    "failed_posts_document",
    LOG,
    """SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS n, concat('{"blog_url":"https://blog-1.example.com","exported_at":"2024-06-01T00:00:00.000Z","count":',
  (SELECT COUNT(*) FROM one_blog WHERE n <= 1), ',"items":[') AS line
UNION ALL SELECT 1, ord, n, concat(CASE WHEN n > 1 THEN ',' ELSE concat(CASE WHEN ord = (SELECT MIN(ord) FROM one_blog) THEN '' ELSE ']},' END,
    '{"post_url":', to_json(post_url), ',"error_messages":[') END, CASE WHEN error_message IS NULL THEN '' ELSE CAST(to_json(error_message) AS VARCHAR) END) FROM one_blog
UNION ALL SELECT 2, 0, 0, CASE WHEN EXISTS (SELECT 1 FROM one_blog) THEN ']}]}' ELSE ']}' END""",
    TAGGED,
    OPEN,
    MESSAGES,
    """one_blog AS (SELECT post_url, first_id AS ord, CASE WHEN worded THEN row_number() OVER (PARTITION BY post_url, worded ORDER BY seen) ELSE 0 END AS n,
  CASE WHEN worded THEN error_message END AS error_message
FROM messages WHERE (worded OR NOT any_worded) AND blog_url = 'https://blog-1.example.com')""",
)
oracle(
    "append_items",
    "job_items",
    """SELECT id, job_id, post_url, CAST(NULL AS BIGINT) AS dest_post_id, 'running' AS status,
  CAST(NULL AS VARCHAR) AS error_message, TIMESTAMP '2024-06-01 00:00:00' AS created_at,
  TIMESTAMP '2024-06-01 00:00:00' AS updated_at FROM job_items""",
)
oracle(
    "assign_ids",
    "image_assets",
    "SELECT event_id, (SELECT MAX(id) FROM image_assets) + row_number() OVER (ORDER BY ts, event_id) AS id FROM events",
)
oracle(
    "resolve_urls",
    "",
    """SELECT event_id,
  CASE WHEN path LIKE 'https://%' THEN path ELSE concat(regexp_replace(blog, '/$', ''), CASE WHEN path LIKE '/%' THEN '' ELSE '/' END, path) END AS below_blog,
  CASE WHEN path LIKE 'https://%' THEN path ELSE concat(regexp_replace(blog, '/$', ''), CASE WHEN path LIKE '/%' THEN '' ELSE '/' END, path) END AS below_origin
FROM (SELECT event_id, concat('https://blog-', user_id % 4, '.example.com', CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END) AS blog,
  CASE event_id % 5 WHEN 0 THEN concat('/', user_id) WHEN 1 THEN concat('p/', user_id) WHEN 2 THEN concat('https://x.example.org/', user_id)
    WHEN 3 THEN concat('//cdn/', user_id) ELSE concat('http:/', user_id) END AS path FROM events)""",
)
oracle(
    "list_page_urls",
    "",
    """SELECT blog_url, CAST(n AS INTEGER) AS page_no,
  CASE WHEN n = 1 THEN blog_url WHEN blog_url LIKE '%?%' THEN concat(blog_url, '&page=', n) ELSE concat(blog_url, '?page=', n) END AS page_url
FROM (SELECT DISTINCT concat('https://blog-', user_id, '.example.com', CASE WHEN user_id % 2 = 0 THEN '/?c=1' ELSE '' END) AS blog_url FROM events), (SELECT unnest([1, 2, 3]) AS n)""",
)
oracle(
    "slugs",
    "",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(lower({trimmed('text')}), '[\s\p{{Z}}\x{{FEFF}}]+', '-', 'g'), '[^\p{{L}}\p{{N}}-]', '', 'g') AS slug FROM documents""",
)
oracle("escape_html", "", f"SELECT page_id, {escaped('html')} AS escaped FROM pages")
oracle(
    "media_file_names",
    "",
    """SELECT doc_id, concat(prefix, '-image.', ext) AS file_name, concat(prefix, '-image-', doc_id + 1, '.', ext) AS numbered_name
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'svg' WHEN 3 THEN 'webp' ELSE 'bin' END AS ext,
  substring(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 15) AS prefix FROM documents)""",
)

# --- discovery ---

DISCOVERED = r"""hrefs AS (SELECT blog_url, page_no, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS h FROM list_pages),
ends AS (SELECT blog_url, MIN(page_no) AS page_end FROM (
  SELECT blog_url, page_no FROM hrefs WHERE len(h) = 0
  UNION ALL SELECT a.blog_url, a.page_no + 1 FROM hrefs a WHERE NOT EXISTS (SELECT 1 FROM hrefs b WHERE b.blog_url = a.blog_url AND b.page_no = a.page_no + 1)) GROUP BY blog_url),
seen AS (SELECT h.blog_url, page_no, unnest(h) AS href, unnest(range(len(h))) AS pos FROM hrefs h JOIN ends e ON e.blog_url = h.blog_url WHERE page_no < page_end),
discovered AS (SELECT blog_url, concat(blog_url, href) AS post_url, MIN(page_no) AS page_no, CAST(arg_min(pos, page_no * 100000 + pos) AS INTEGER) AS pos FROM seen GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY blog_url ORDER BY page_no, pos) AS n FROM discovered)"""
oracle("discover_urls", "list_pages", "SELECT * FROM numbered", DISCOVERED)
CRAWLED = "crawled AS (SELECT DISTINCT j.blog_url, i.post_url FROM crawl_items i JOIN post_jobs j ON i.job_id = j.id)"
oracle(
    "pending_urls",
    "list_pages post_jobs crawl_items",
    "SELECT * FROM discovered d WHERE NOT EXISTS (SELECT 1 FROM crawled c WHERE c.blog_url = d.blog_url AND c.post_url = d.post_url)",
    DISCOVERED,
    CRAWLED,
)
oracle(
    "dispatch_discovered",
    "list_pages",
    """SELECT blog_url, post_url, n, CAST(floor((n - 1) / 2) AS BIGINT) AS slot, CAST(floor((n - 1) / 2) AS BIGINT) * 1000 AS start_ms, (n - 1) % 3 AS lane FROM numbered""",
    DISCOVERED,
)

# --- posts, by arithmetic on the page id ---

POSTS = f"""p AS (SELECT page_id AS p, {PAGE_WORDS} AS words, concat('https://blog-', page_id % 4, '.example.com') AS blog,
  concat('https://blog-', page_id % 4, '.example.com/', page_id) AS url,
  CASE WHEN page_id % 10 < 2 THEN 'Untitled' ELSE concat('Post & 글 ', page_id) END AS title,
  CASE WHEN page_id % 17 <> 0 THEN make_timestamp(2024, 1, 1 + page_id % 28, 1, 0, 0) END AS published,
  CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS modified,
  CASE page_id % 4 WHEN 0 THEN concat('https://img.example.com/f', page_id, '.jpg')
    WHEN 1 THEN concat('https://blog-1.example.com/images/f', page_id, '.jpg') END AS featured,
  CASE WHEN page_id % 2 = 0 THEN concat('https://site-', page_id % 50, '.example.org/a') END AS bookmark,
  concat('https://img.example.com/', page_id % 40, '.jpg') AS image FROM pages)"""
oracle("post_titles", "", "SELECT url, title FROM p", POSTS)
oracle("post_dates", "", "SELECT url, published AS publish_date, published IS NULL AS publish_date_invalid, modified AS modified_date FROM p", POSTS)
oracle("post_errors", "", "SELECT blog AS blog_url, url, 'publish date' AS stage, 'Invalid time value' AS message FROM p WHERE published IS NULL", POSTS)
CATEGORIES = """categories AS (
  SELECT p, url, CAST(0 AS INTEGER) AS pos, concat('Cat ', p % 5) AS name, concat('cat-', p % 5) AS slug, CAST(NULL AS VARCHAR) AS parent_name FROM p WHERE p % 4 >= 1
  UNION ALL SELECT p, url, 1, concat('개발 ', p % 3), concat('개발-', p % 3), concat('Cat ', p % 5) FROM p WHERE p % 4 >= 2)"""
TAGS = """tags AS (SELECT p, url, CAST(0 AS INTEGER) AS pos, concat('Tag', p % 11) AS name, concat('tag', p % 11) AS slug FROM p
  UNION ALL SELECT p, url, 1, 'Node.js', 'nodejs' FROM p)"""
oracle("post_categories", "", "SELECT * EXCLUDE (p) FROM categories", POSTS, CATEGORIES)
oracle("post_tags", "", "SELECT * EXCLUDE (p) FROM tags", POSTS, TAGS)
oracle("featured_images", "", "SELECT url, featured AS featured_image_url FROM p", POSTS)
oracle("bookmarks", "", "SELECT url, CAST(0 AS INTEGER) AS pos, bookmark AS bookmark_url FROM p WHERE bookmark IS NOT NULL", POSTS)
IMAGES = """images AS (SELECT p, url, title, CAST(0 AS INTEGER) AS pos, image AS image_url, 'one' AS alt_text FROM p WHERE p % 3 >= 1
  UNION ALL SELECT p, url, title, 1, 'https://img.example.com/t.png?a=1&b=2', NULL FROM p WHERE p % 3 >= 2)"""
oracle("post_images", "", "SELECT url, pos, image_url, alt_text FROM images", POSTS, IMAGES)
oracle(
    "post_links",
    "",
    """SELECT url, CAST(0 AS INTEGER) AS pos, concat(blog, '/', p + 1) AS target_url, 'next post' AS link_text, 'Body bold it 2 see next post and ext m f' AS context FROM p
UNION ALL SELECT url, 3, concat(blog, '/#frag'), 'f', 'Body bold it 2 see next post and ext m f' FROM p""",
    POSTS,
)
oracle(
    "internal_links",
    "",
    r"""SELECT page_id, CAST(pos AS INTEGER) AS pos, concat(origin, replace(replace(url_encode(href), '%2F', '/'), '%2C', ',')) AS target_url, substring(href, 2) AS link_text, substring(href, 2) AS context
FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, unnest(h) AS href, unnest(range(len(h))) AS pos
  FROM (SELECT *, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS h FROM pages))""",
)

# --- previews and content ---

# The card that the destination shows, and its text nodes.
EXPECTED_CARD = (
    '<figure class="bookmark-card" style="border: 1px solid #e5e7eb; border-radius: 10px; overflow: hidden; background-color: #ffffff; box-shadow: 0 2px 6px rgba(0, 0, 0, 0.05); margin: 12px 0; min-height: 80px; position: relative">\n'
    '    <a class="bookmark-overlay-link" href="{url}" target="_blank" rel="noopener noreferrer" aria-label="{title}" style="position: absolute; inset: 0; display: block; z-index: 3; text-decoration: none"></a>\n'
    '    <div class="bookmark-row" style="display: flex; gap: 14px; align-items: stretch; position: relative; z-index: 1">\n'
    '    <div class="bookmark-featured-image" style="position: relative; background-color: #f3f4f6; overflow: hidden; flex: 0 0 30%">{image}</div>\n'
    '    <div class="bookmark-content" style="padding: 12px 14px; display: flex; flex-direction: column; justify-content: center; flex: 1">\n'
    '      <p class="bookmark-title" style="margin: 0 0 4px 0; font-size: 0.95rem; font-weight: 500; color: #111827; line-height: 1.3; overflow-wrap: anywhere">\n'
    '        {title}\n'
    '      </p>\n'
    '      {description}\n'
    '    </div>\n'
    '  </div>\n'
    '  </figure>'
)
EXPECTED_IMAGE = (
    '\n'
    '        <img src="{image_url}" alt="{title}" style="width: 100%; height: 100%; object-fit: cover; display: block" />\n'
    '      '
)
EXPECTED_DESCRIPTION = '<p class="bookmark-description" style="margin: 4px 0 0 0; font-size: 0.85rem; color: #6b7280; line-height: 1.4; max-height: 3.6em; overflow: hidden">{text}</p>'
EXPECTED_TEXT = (
    '\n'
    '    \n'
    '    \n'
    '    {image}\n'
    '    \n'
    '      \n'
    '        {title}\n'
    '      \n'
    '      {description}\n'
    '    \n'
    '  \n'
    '  '
)
EXPECTED_TEXT_IMAGE = '\n        \n      '

PREVIEWS = """previews AS (SELECT concat('https://site-', s, '.example.org/a') AS url,
  CASE WHEN s % 10 IN (0, 2) THEN concat('OG ', s) WHEN s % 10 = 4 THEN concat('T ', s) ELSE concat('https://site-', s, '.example.org/a') END AS title,
  CASE WHEN s % 10 IN (0, 2) THEN 'D <b>' END AS description,
  CASE WHEN s % 10 = 0 THEN 'https://cdn.example.org/og.png' WHEN s % 10 IN (2, 4) THEN concat('https://site-', s, '.example.org/favicon.ico') END AS image,
  CASE WHEN s % 10 = 8 THEN 'page could not be fetched' END AS error
FROM (SELECT DISTINCT page_id % 50 AS s FROM pages WHERE page_id % 2 = 0))"""
oracle("preview_metadata", "", "SELECT * FROM previews", PREVIEWS)
_CARD_IMAGE = filled(EXPECTED_IMAGE, {"image_url": escaped("image"), "title": escaped("title")})
_CARD_DESCRIPTION = filled(EXPECTED_DESCRIPTION, {"text": escaped("description")})
_CARD = filled(
    EXPECTED_CARD,
    {
        "url": escaped("url"),
        "title": escaped("title"),
        "image": f"CASE WHEN image IS NULL THEN '' ELSE {_CARD_IMAGE} END",
        "description": f"CASE WHEN description IS NULL THEN '' ELSE {_CARD_DESCRIPTION} END",
    },
)
_CONTEXT = filled(
    EXPECTED_TEXT,
    {
        "title": "title",
        "image": f"CASE WHEN image IS NULL THEN '' ELSE {quoted(EXPECTED_TEXT_IMAGE)} END",
        "description": "COALESCE(description, '')",
    },
)
CARDS = f"cards AS (SELECT url AS bookmark_url, {_CARD} AS card, {trimmed(f'substring({_CONTEXT}, 1, 50)')} AS context FROM previews)"
oracle(
    "bookmark_cards",
    "",
    "SELECT p.url, CAST(0 AS INTEGER) AS pos, c.* FROM p JOIN cards c ON c.bookmark_url = p.bookmark",
    POSTS,
    PREVIEWS,
    CARDS,
)


def content_sql(bookmark: str, image: str, table_image: str) -> str:
    return f"""concat('<p>Body <strong>bold</strong> <em>it</em> <sup>2</sup> see <a href="/', p + 1,
  '">next post</a> and <a href="https://other.example.org/x">ext</a> <a href="mailto:a@b.c">m</a> <a href="#frag">f</a></p>',
  CASE WHEN p % 2 = 0 THEN concat(chr(10), {bookmark}) ELSE '' END,
  CASE WHEN p % 3 >= 1 THEN concat(chr(10), '<p><img src="', {image}, '" alt="one"></p>') ELSE '' END,
  CASE WHEN p % 3 >= 2 THEN concat(chr(10), '<table><thead><tr><th>H</th></tr></thead><tbody><tr><td>1<img src="', {table_image}, '" width="5"></td></tr></tbody></table>') ELSE '' END,
  CASE WHEN p % 7 = 0 THEN concat(chr(10), '<iframe src="https://player.example.net/v/1" width="400" height="225" allowfullscreen="true"></iframe>') ELSE '' END,
  chr(10), '<p>', words, '</p>')"""


_PLAIN = """concat('<p><a href="', bookmark, '">bm</a></p>')"""
_TABLE_IMAGE = "'https://img.example.com/t.png?a=1&amp;b=2'"
CLEAN = content_sql(_PLAIN, "image", _TABLE_IMAGE)
CARDED = content_sql("concat('<!-- wp:html -->', card, '<!-- /wp:html -->')", "p.image", _TABLE_IMAGE)
REWRITTEN = content_sql(
    _PLAIN,
    "CASE WHEN p % 5 = 0 THEN image ELSE concat('https://dest.example.com/m?p=', p, '&amp;s=1') END",
    f"CASE WHEN p % 2 = 0 THEN {_TABLE_IMAGE} ELSE concat('https://dest.example.com/t/', p, '.png') END",
)
oracle("clean_content", "", f"SELECT url, {CLEAN} AS content FROM p", POSTS)
oracle(
    "rewrite_images",
    "",
    f"""SELECT url, {REWRITTEN} AS content, concat_ws(' ',
  CASE WHEN p % 3 >= 1 AND p % 5 <> 0 THEN concat('0|', image, '|', p + 700000, '|https://dest.example.com/m?p=', p, '&s=1') END,
  CASE WHEN p % 3 >= 2 AND p % 2 <> 0 THEN concat('1|https://img.example.com/t.png?a=1&b=2|', p + 800000, '|https://dest.example.com/t/', p, '.png') END) AS uploads FROM p""",
    POSTS,
)
oracle(
    "posts",
    "",
    f"""SELECT p.url, title, {CARDED} AS content, strftime(published, '%Y-%m-%dT%H:%M:%S.000Z') AS publish_date,
  strftime(modified, '%Y-%m-%dT%H:%M:%S.000Z') AS modified_date,
  concat_ws('|', CASE WHEN p % 4 >= 1 THEN concat('Cat ', p % 5) END, CASE WHEN p % 4 >= 2 THEN concat('개발 ', p % 3) END) AS categories,
  concat('Tag', p % 11, '|Node.js') AS tags, CAST(p % 3 AS INTEGER) AS n_images, featured AS featured_image_url
FROM p LEFT JOIN cards ON cards.bookmark_url = p.bookmark""",
    POSTS,
    PREVIEWS,
    CARDS,
)
oracle(
    "stream_parse",
    "",
    f"SELECT url, title, CAST(p % 3 AS INTEGER) AS n_images, CAST(CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_bookmarks, {CLEAN} AS content FROM p",
    POSTS,
)
oracle(
    "content_retention",
    "",
    """SELECT url, CAST(n AS INTEGER) AS chars_before, CAST(n AS INTEGER) AS chars_after
FROM (SELECT url, 30 + CASE WHEN p % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN p % 3 = 2 THEN 2 ELSE 0 END + length(replace(words, ' ', '')) AS n FROM p)""",
    POSTS,
)

# real pages: all visible text stays, so tags and references can be taken off by pattern
_TEXT = "regexp_replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<[^>]*>', '', 'g')"
for _reference, _character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'")):
    _TEXT = f"replace({_TEXT}, {quoted(_reference)}, {quoted(_character)})"
_TEXT = rf"regexp_replace(regexp_replace({_TEXT}, '&amp;?', '&', 'g'), '[\s\p{{Z}}\x{{FEFF}}]+', '', 'g')"
oracle(
    "page_retention",
    "",
    f"SELECT page_id, CAST(n AS INTEGER) AS chars_before, CAST(n AS INTEGER) AS chars_after, true AS kept_99 FROM (SELECT page_id, length({_TEXT}) AS n FROM pages)",
)

# --- media and terms ---

PLAN = """plan AS (SELECT url, title, CAST(-1 AS INTEGER) AS pos, featured AS image_url, concat('Featured image for ', title) AS alt_text FROM p WHERE featured IS NOT NULL
  UNION ALL SELECT url, title, pos, image_url, alt_text FROM images)"""
_PREFIX = "CASE WHEN title = 'Untitled' THEN 'untitled' ELSE concat('post-', regexp_extract(title, '[0-9]+$')) END"
oracle(
    "media_plan",
    "",
    f"""SELECT url, pos, image_url, alt_text, concat(substring({_PREFIX}, 1, 15), '-image.', CASE WHEN pos < 0 THEN 'bin' ELSE 'jpg' END) AS file_name, 'pending' AS status FROM plan""",
    POSTS,
    IMAGES,
    PLAN,
)
oracle(
    "media_plan_deduped",
    "",
    f"""SELECT url, pos, image_url, alt_text, concat(substring({_PREFIX}, 1, 15), '-image.bin') AS file_name, 'pending' AS status FROM plan
QUALIFY row_number() OVER (PARTITION BY image_url ORDER BY url, pos) = 1""",
    POSTS,
    IMAGES,
    PLAN,
)
FAILED_UPLOADS = """uploads AS (SELECT a.*, EXISTS (SELECT 1 FROM featured_of_item f WHERE f.job_item_id = a.job_item_id AND f.image_url = a.image_url) AS is_featured
  FROM image_assets a JOIN job_items i ON i.id = a.job_item_id WHERE i.status = 'failed' AND a.status = 'uploaded')"""
oracle(
    "rollback_plan",
    "job_items image_assets featured_of_item",
    """SELECT job_item_id, CAST(CASE WHEN is_featured THEN 1 ELSE 2 END AS INTEGER) AS step, 'media' AS kind, dest_media_id AS target_id, id AS asset_id FROM uploads
UNION ALL SELECT id, 3, 'post', id + 300000, NULL FROM job_items WHERE status = 'failed' AND id % 3 = 0""",
    FAILED_UPLOADS,
)
oracle(
    "orphaned_media",
    "job_items image_assets featured_of_item",
    """SELECT id, job_item_id, image_url, dest_media_id FROM uploads u WHERE NOT is_featured
  AND EXISTS (SELECT 1 FROM image_assets b WHERE b.job_item_id = u.job_item_id AND b.status = 'failed')""",
    FAILED_UPLOADS,
)
TERMS = """uses AS (SELECT 'category' AS taxonomy, name, p, 0 AS k, pos * 2 + 1 AS i, parent_name FROM categories
  UNION ALL SELECT 'category', parent_name, p, 0, pos * 2, NULL FROM categories WHERE parent_name IS NOT NULL
  UNION ALL SELECT 'tag', name, p, 1, pos, NULL FROM tags),
first_uses AS (SELECT * FROM uses QUALIFY row_number() OVER (PARTITION BY taxonomy, name ORDER BY p, k, i) = 1),
known AS (SELECT taxonomy, name, MIN(id) AS id FROM existing_terms GROUP BY ALL),
fresh AS (SELECT taxonomy, name, parent_name, (SELECT MAX(id) FROM existing_terms) + row_number() OVER (ORDER BY p, k, i) AS id FROM first_uses f
  WHERE NOT EXISTS (SELECT 1 FROM known n WHERE n.taxonomy = f.taxonomy AND n.name = f.name)),
terms AS (SELECT f.taxonomy, f.name, n.id, false AS is_new, NULL AS parent_name FROM first_uses f JOIN known n ON n.taxonomy = f.taxonomy AND n.name = f.name
  UNION ALL SELECT taxonomy, name, id, true, parent_name FROM fresh)"""
oracle(
    "ensure_terms",
    "existing_terms",
    """SELECT t.taxonomy, t.name, t.id, t.is_new, COALESCE(u.id, 0) AS parent_id FROM terms t LEFT JOIN terms u ON u.taxonomy = 'category' AND t.taxonomy = 'category' AND u.name = t.parent_name""",
    POSTS,
    CATEGORIES,
    TAGS,
    TERMS,
)
oracle(
    "post_payloads",
    "existing_terms",
    f"""SELECT url, title, {CLEAN} AS content, 'pending' AS status, strftime(published, '%Y-%m-%dT%H:%M:%S.000Z') AS date,
  COALESCE((SELECT string_agg(t.id, ',' ORDER BY c.pos) FROM categories c JOIN terms t ON t.taxonomy = 'category' AND t.name = c.name WHERE c.p = p.p), '') AS categories,
  (SELECT string_agg(t.id, ',' ORDER BY c.pos) FROM tags c JOIN terms t ON t.taxonomy = 'tag' AND t.name = c.name WHERE c.p = p.p) AS tags,
  CASE WHEN p % 5 <> 0 THEN p + 700000 END AS featured_media FROM p WHERE published IS NOT NULL""",
    POSTS,
    CATEGORIES,
    TAGS,
    TERMS,
)

# --- history ---

oracle("attempted_urls", LOG, "SELECT DISTINCT blog_url, post_url FROM tagged", TAGGED)
oracle("retry_urls", LOG, "SELECT blog_url, post_url FROM states WHERE done = 0 AND bad > 0", TAGGED, STATES)
oracle("stream_retry_set", LOG, "SELECT blog_url, post_url FROM states WHERE done = 0 AND bad > 0", TAGGED, STATES)
oracle("stuck_urls", LOG, "SELECT blog_url, post_url FROM states WHERE done = 0 AND bad = 0", TAGGED, STATES)
oracle("unresolved_failures", LOG, "SELECT * FROM open_failures", TAGGED, OPEN)
SUMMARY = """summary AS (SELECT j.id AS job_id, blog_url, job_type, COUNT(i.id) AS detected, COUNT(CASE WHEN i.status = 'completed' THEN 1 END) AS completed,
  COUNT(CASE WHEN i.status = 'failed' THEN 1 END) AS failed, CAST(0 AS BIGINT) AS skipped, COUNT(CASE WHEN i.status IN ('completed', 'failed') THEN 1 END) AS processed
  FROM post_jobs j LEFT JOIN job_items i ON i.job_id = j.id GROUP BY ALL)"""
oracle("job_summary", LOG, "SELECT * FROM summary", SUMMARY)
oracle(
    "finalize_jobs",
    LOG,
    """SELECT job_id, CASE WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN failed > 0 THEN 'Some items failed to migrate' END AS error_message,
  TIMESTAMP '2024-06-01 00:00:00' AS completed_at, CAST(CASE WHEN failed > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM summary""",
    SUMMARY,
)
oracle(
    "latest_running_job",
    "post_jobs",
    "SELECT * FROM post_jobs WHERE status = 'running' QUALIFY row_number() OVER (PARTITION BY job_type, blog_url ORDER BY id DESC) = 1",
)
oracle("items_by_job", "job_items", "SELECT * FROM job_items WHERE status = 'failed'")
oracle("links_by_job", "internal_links job_items", "SELECT l.*, i.job_id FROM internal_links l JOIN job_items i ON l.job_item_id = i.id")
oracle("images_by_item", "image_assets", "SELECT * FROM image_assets WHERE job_item_id = 7")
oracle("items_of_one_job", "job_items", "SELECT * FROM job_items WHERE status = 'failed' AND job_id = 2")
oracle(
    "links_of_one_job",
    "internal_links job_items",
    "SELECT l.*, i.job_id FROM internal_links l JOIN job_items i ON l.job_item_id = i.id WHERE i.job_id = 2",
)
oracle("links_by_item", "internal_links", "SELECT * FROM internal_links WHERE job_item_id = 9")
oracle("item_by_id", "job_items", "SELECT * FROM job_items WHERE id = 42")
oracle(
    "map_lookup",
    "job_items post_map",
    "SELECT u.post_url, m.id AS map_id, m.dest_post_id FROM (SELECT DISTINCT post_url FROM job_items) u LEFT JOIN post_map m ON m.post_url = u.post_url",
)
oracle(
    "attempt_numbers",
    LOG,
    "SELECT id, blog_url, post_url, status, row_number() OVER (PARTITION BY blog_url, post_url ORDER BY id) AS attempt FROM tagged",
    TAGGED,
)
oracle(
    "resolve_links",
    "internal_links post_map",
    "SELECT l.*, m.dest_post_id, m.dest_post_id IS NULL AS dangling FROM internal_links l LEFT JOIN post_map m ON m.post_url = l.target_url",
)
oracle(
    "failure_causes",
    "job_items",
    """SELECT CASE WHEN error_message IS NULL THEN 'none given' WHEN error_message LIKE '%timeout%' THEN 'timeout' WHEN error_message LIKE '%429%' THEN 'rate limited'
  WHEN error_message LIKE '%500%' THEN 'server error' ELSE 'other' END AS cause, COUNT(*) AS items FROM job_items WHERE status = 'failed' GROUP BY 1""",
)
oracle(
    "extend_post_map",
    LOG,
    """SELECT id, post_url, dest_post_id, CASE WHEN n > 1 OR post_url IN (SELECT post_url FROM done WHERE job_type = 'full') THEN 'post_url already mapped' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY post_url ORDER BY id) AS n FROM done WHERE job_type <> 'full')""",
    "done AS (SELECT i.*, j.job_type FROM job_items i JOIN post_jobs j ON j.id = i.job_id WHERE i.status = 'completed')",
)
oracle(
    "apply_item_patches",
    "job_items item_patches",
    """SELECT i.id, i.job_id, i.post_url, CASE WHEN d.id IS NULL THEN i.dest_post_id ELSE CAST(d.value AS BIGINT) END AS dest_post_id,
  CASE WHEN s.id IS NULL THEN i.status ELSE s.value END AS status, CASE WHEN e.id IS NULL THEN i.error_message ELSE e.value END AS error_message, i.created_at, i.updated_at
FROM job_items i LEFT JOIN latest d ON d.id = i.id AND d.field = 'dest_post_id' LEFT JOIN latest s ON s.id = i.id AND s.field = 'status'
  LEFT JOIN latest e ON e.id = i.id AND e.field = 'error_message'""",
    "latest AS (SELECT * FROM item_patches QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) = 1)",
)
NEWEST = "newest AS (SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) = 1)"


def patched(field: str, kind: str, otherwise: str) -> str:
    """The newest patch of a field, or the old value; a patch may set NULL."""
    found = f"SELECT {{}} FROM newest n WHERE n.id = r.id AND n.field = '{field}'"
    return (
        f"CASE WHEN EXISTS ({found.format('1')}) THEN CAST(({found.format('value')}) AS {kind}) "
        f"ELSE {otherwise} END AS {field}"
    )


oracle(
    "apply_job_patches",
    "post_jobs job_patches",
    f"""SELECT id, blog_url, job_type, {patched('status', 'VARCHAR', 'status')}, created_at, CAST(NULL AS TIMESTAMP) AS completed_at,
  {patched('error_message', 'VARCHAR', 'NULL')} FROM post_jobs r""",
    NEWEST.format("job_patches"),
)
oracle(
    "apply_asset_patches",
    "image_assets asset_patches",
    f"""SELECT id, job_item_id, image_url, {patched('status', 'VARCHAR', 'status')}, {patched('dest_media_id', 'BIGINT', 'dest_media_id')}, created_at, updated_at,
  {patched('dest_media_url', 'VARCHAR', 'NULL')}, CAST(NULL AS VARCHAR) AS error_message FROM image_assets r""",
    NEWEST.format("asset_patches"),
)
oracle(
    "failure_patches",
    LOG,
    """SELECT id, CAST(9 AS BIGINT) AS seq, unnest(['status', 'error_message']) AS field, unnest(['failed', concat('broken ', post_url)]) AS value
FROM tagged r WHERE status = 'running' AND EXISTS (SELECT 1 FROM tagged b WHERE b.blog_url = r.blog_url AND b.post_url = r.post_url AND b.status = 'running' AND b.id % 4 = 0)""",
    TAGGED,
)
oracle(
    "stream_item_state",
    "item_patches",
    "SELECT id, field, value, seq FROM item_patches QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) = 1",
)
oracle(
    "cascade_delete",
    "post_jobs image_assets internal_links post_map",
    """SELECT 'post_jobs' AS table_name, id FROM post_jobs WHERE job_type <> 'retry'
UNION ALL SELECT 'job_items', id FROM kept_items
UNION ALL SELECT 'image_assets', id FROM image_assets WHERE job_item_id IN (SELECT id FROM kept_items)
UNION ALL SELECT 'internal_links', id FROM internal_links WHERE job_item_id IN (SELECT id FROM kept_items)
UNION ALL SELECT 'post_map', id FROM post_map""",
    "kept_items AS (SELECT id FROM job_items WHERE job_id IN (SELECT id FROM post_jobs WHERE job_type <> 'retry'))",
)
NOT_NULL_COLUMNS = {
    "post_jobs": "blog_url job_type status created_at",
    "job_items": "job_id post_url status created_at updated_at",
    "image_assets": "job_item_id image_url status created_at updated_at",
    "internal_links": "job_item_id source_url target_url created_at",
    "map": "post_url dest_post_id created_at",
}
BREACHES = [
    f"SELECT '{column} not null' AS rule, '{'post_map' if table == 'map' else table}' AS table_name, CAST(id AS VARCHAR) AS key, "
    f"CAST(1 AS BIGINT) AS n FROM broken_{table} WHERE {column} IS NULL"
    for table, columns in NOT_NULL_COLUMNS.items()
    for column in columns.split()
]
BREACHES += [
    f"SELECT '{column} allowed', '{table}', CAST(id AS VARCHAR), 1 FROM broken_{table} WHERE {column} NOT IN ({allowed})"
    for table, column, allowed in (
        ("post_jobs", "job_type", "'full', 'single', 'retry'"),
        ("post_jobs", "status", "'running', 'completed', 'failed'"),
        ("job_items", "status", "'running', 'completed', 'failed'"),
        ("image_assets", "status", "'pending', 'uploaded', 'failed'"),
    )
]
BREACHES += [
    f"SELECT '{column} refers to {parent}', '{table}', CAST(c.id AS VARCHAR), 1 FROM broken_{table} c "
    f"WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM broken_{parent} p WHERE p.id = c.{column})"
    for table, column, parent in (
        ("job_items", "job_id", "post_jobs"),
        ("image_assets", "job_item_id", "job_items"),
        ("internal_links", "job_item_id", "job_items"),
    )
]
BREACHES += [
    f"SELECT '{column} unique', 'post_map', CAST({column} AS VARCHAR), COUNT(*) FROM broken_map WHERE {column} IS NOT NULL GROUP BY {column} HAVING COUNT(*) > 1"
    for column in ("post_url", "dest_post_id")
]
oracle(
    "constraint_violations",
    "broken_post_jobs broken_job_items broken_image_assets broken_internal_links broken_map",
    "\nUNION ALL ".join(BREACHES),
)

# --- plans and streams ---

OPEN_POSTS = """open_posts AS (SELECT * FROM discovered d WHERE NOT EXISTS (SELECT 1 FROM crawled c WHERE c.blog_url = d.blog_url AND c.post_url = d.post_url))"""
oracle(
    "full_run",
    "list_pages post_jobs crawl_items",
    """SELECT blog_url, post_url, n, CAST(floor((n - 1) / 2) AS BIGINT) AS slot, CAST(floor((n - 1) / 2) AS BIGINT) * 1000 AS start_ms, (n - 1) % 3 AS lane
FROM (SELECT blog_url, post_url, row_number() OVER (PARTITION BY blog_url ORDER BY page_no, pos) AS n FROM open_posts)""",
    DISCOVERED,
    CRAWLED,
    OPEN_POSTS,
)
oracle(
    "full_run_summary",
    "list_pages post_jobs job_items crawl_items",
    """SELECT s.* EXCLUDE (skipped), CAST(COALESCE(k.n, 0) AS BIGINT) AS skipped FROM summary s LEFT JOIN
  (SELECT r.id, (SELECT COUNT(*) FROM discovered d WHERE d.blog_url = r.blog_url) - (SELECT COUNT(*) FROM open_posts o WHERE o.blog_url = r.blog_url) AS n
   FROM (SELECT blog_url, MAX(id) AS id FROM post_jobs WHERE status = 'running' AND job_type = 'full' GROUP BY blog_url) r) k ON k.id = s.job_id""",
    DISCOVERED,
    CRAWLED,
    OPEN_POSTS,
    SUMMARY,
)
oracle(
    "retry_run",
    LOG,
    """SELECT blog_url, post_url, n, CAST(floor((n - 1) / 2) AS BIGINT) AS slot, CAST(floor((n - 1) / 2) AS BIGINT) * 1000 AS start_ms, (n - 1) % 3 AS lane
FROM (SELECT blog_url, post_url, row_number() OVER (PARTITION BY blog_url ORDER BY post_url) AS n FROM states WHERE done = 0 AND bad > 0)""",
    TAGGED,
    STATES,
)

oracle(
    "dispatch_plan",
    LOG,
    """SELECT blog_url, post_url, n, CAST(floor((n - 1) / 3) AS BIGINT) AS slot, CAST(floor((n - 1) / 3) AS BIGINT) * 60000 AS start_ms, (n - 1) % 4 AS lane
FROM (SELECT blog_url, post_url, row_number() OVER (PARTITION BY blog_url ORDER BY post_url) AS n FROM states WHERE done = 0 AND bad > 0)""",
    TAGGED,
    STATES,
)
oracle(
    "retry_plan",
    LOG,
    """SELECT blog_url, post_url, CAST(bad AS BIGINT) AS n, bad >= 3 AS exhausted, CAST(CASE bad WHEN 1 THEN 500 WHEN 2 THEN 4000 END AS BIGINT) AS delay_ms
FROM states WHERE done = 0 AND bad > 0""",
    TAGGED,
    STATES,
)
USAGE = """SELECT concat('https://blog-', user_id % 4, '.example.com') AS blog_url, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS interval_start, COUNT(*) AS starts, COUNT(*) > 5 AS over_cap
FROM events GROUP BY 1, 2"""
oracle("rate_usage", "", USAGE)
oracle("stream_rate_usage", "", USAGE)
oracle("stream_closed_usage", "", USAGE)
oracle(
    "stream_new_urls",
    "list_pages post_jobs crawl_items",
    "SELECT blog_url, post_url FROM open_posts",
    DISCOVERED,
    CRAWLED,
    OPEN_POSTS,
)
oracle("stream_retry_changes", LOG, "SELECT blog_url, post_url FROM states WHERE done = 0 AND bad > 0", TAGGED, STATES)
oracle(
    "stream_item_changes",
    "item_patches",
    "SELECT id, field, value, seq FROM item_patches QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY seq DESC) = 1",
)
oracle(
    "stream_retry_due",
    LOG,
    """SELECT blog_url, post_url, n, CASE WHEN n >= 3 THEN 'exhausted' WHEN last_ms + delay_ms <= (SELECT max(epoch_ms(created_at)) FROM tagged) THEN 'sent' ELSE 'queued' END AS event, delay_ms
FROM (SELECT blog_url, post_url, CAST(bad AS BIGINT) AS n, CAST(CASE bad WHEN 1 THEN 500 WHEN 2 THEN 4000 END AS BIGINT) AS delay_ms,
  (SELECT max(epoch_ms(created_at)) FROM tagged f WHERE f.status = 'failed' AND f.blog_url = s.blog_url AND f.post_url = s.post_url) AS last_ms
  FROM states s WHERE done = 0 AND bad > 0)""",
    TAGGED,
    STATES,
)
oracle("list_pages_table", "list_pages", "SELECT * FROM list_pages")
oracle(
    "history_tables",
    "job_items post_jobs image_assets internal_links post_map",
    """SELECT t.id, t.blog_url, t.status, (SELECT COUNT(*) FROM image_assets a WHERE a.job_item_id = t.id) AS n_assets,
  (SELECT COUNT(*) FROM internal_links l WHERE l.job_item_id = t.id) AS n_links, m.dest_post_id FROM tagged t LEFT JOIN post_map m ON m.id = t.id""",
    TAGGED,
)
oracle(
    "written_posts",
    "posts_raw",
    "SELECT blog_url, url, CASE WHEN page_id % 4 = 2 THEN lower(html) ELSE html END AS html FROM posts_raw",
)
oracle(
    "converted_content",
    "",
    """SELECT page_id, CASE WHEN html = '' OR c = '' THEN '' ELSE concat('<p>', c, '</p>') END AS content
FROM (SELECT page_id, html, trim(regexp_replace(html, '<[^>]*>', ' ', 'g'), ' ') AS c FROM pages)""",
)
oracle(
    "token_overlap",
    "",
    r"""SELECT doc_id, CAST(len(b) AS BIGINT) AS n_before, CAST(len(a) AS BIGINT) AS n_after, CAST(COALESCE(common, 0) AS BIGINT) AS n_common, sha256(COALESCE(lost, '')) AS lost_sha256
FROM docs LEFT JOIN sums USING (doc_id)""",
    r"""docs AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS b,
  regexp_extract_all(COALESCE(CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'a') ELSE text END, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
each AS (SELECT doc_id, unnest(b) AS word, 1 AS x, 0 AS y FROM docs UNION ALL SELECT doc_id, unnest(a), 0, 1 FROM docs),
counts AS (SELECT doc_id, word, sum(x) AS x, sum(y) AS y FROM each GROUP BY doc_id, word),
sums AS (SELECT doc_id, sum(least(x, y)) AS common, string_agg(concat(word, ' ', x - y), chr(10) ORDER BY word) FILTER (x > y) AS lost FROM counts GROUP BY doc_id)""".replace("\\\\", "\\"),
)
oracle(
    "failure_templates",
    "messages",
    """SELECT template, COUNT(*) AS items, COUNT(DISTINCT COALESCE(error_message, '')) AS messages, template <> '' AS named FROM
  (SELECT error_message, CASE WHEN error_message IS NULL THEN '' WHEN error_message LIKE 'patched %' THEN 'patched <*>'
    WHEN error_message LIKE '  blog %' THEN regexp_replace(trim(error_message), '[0-9]+$', '<*>') WHEN error_message LIKE 'HTTP 500' THEN 'HTTP 500' ELSE error_message END AS template FROM messages)
GROUP BY template""",
)
oracle(
    "resolve_aliases",
    "moved_links moved_map",
    """SELECT id, target, k, target_url, CASE WHEN k < 5 OR (k < 7 AND target % 7 <> 0) THEN d END AS dest_post_id,
  NOT (d IS NOT NULL AND (k < 5 OR (k < 7 AND target % 7 <> 0))) AS dangling
FROM (SELECT l.*, (SELECT dest_post_id FROM moved_map m WHERE m.id = l.target + 1) AS d FROM moved_links l)""",
)
oracle(
    "stream_outcomes",
    "job_items outcomes",
    """SELECT id, 'mapped' AS what, CAST(dest_post_id AS VARCHAR) AS value FROM done WHERE reason IS NULL
UNION ALL SELECT id, 'refused', reason FROM done WHERE reason IS NOT NULL
UNION ALL SELECT id, 'refused', reason FROM checked WHERE reason IS NOT NULL
UNION ALL SELECT id, 'status', CASE WHEN reason IS NULL THEN 'completed' ELSE 'failed' END FROM done
UNION ALL SELECT id, 'status', 'failed' FROM checked WHERE reason IS NULL AND status = 'failed'""",
    """checked AS (SELECT o.*, i.post_url, CASE WHEN i.id IS NULL THEN 'unknown item' WHEN o.status = 'paused' THEN 'status not allowed'
    WHEN o.status = 'completed' AND o.dest_post_id IS NULL THEN 'completed without a post' END AS reason FROM outcomes o LEFT JOIN job_items i ON i.id = o.id),
done AS (SELECT id, dest_post_id, CASE WHEN n > 1 OR post_url IN (SELECT post_url FROM job_items WHERE status = 'completed' AND job_id % 3 = 0) THEN 'post_url already mapped' END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY post_url ORDER BY id) AS n FROM checked WHERE reason IS NULL AND status = 'completed'))""",
)

import glob
import json

from pyspark.sql import functions as F

from inkferry import schemas
from inkferry.sources import exports, tables


def document(path):
    text = ""
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part, encoding="utf-8") as lines:
            text += lines.read()
    return json.loads(text)


def now():
    return F.lit("2024-06-01 10:00:00").cast("timestamp")


def log(spark):
    jobs = spark.createDataFrame([(1, "https://a"), (2, "https://b")], "id long, blog_url string")
    items = spark.createDataFrame(
        [(1, 1, "https://a/1", "failed", 'say "no"'), (2, 1, "https://a/2", "failed", None), (3, 1, "https://a/1", "failed", "b"), (4, 2, "https://b/1", "failed", "x")],
        "id long, job_id long, post_url string, status string, error_message string",
    )
    return jobs, items


def test_link_report(spark, tmp_path):
    jobs, items = log(spark)
    rows = [(i, 1, "s", f"t{i}", None if i % 3 else 'l "<&>" 🎉', "" if i % 2 else None) for i in range(1, 301)] + [(999, 4, "s", "t", None, None)]
    links = spark.createDataFrame(rows, "id long, job_item_id long, source_url string, target_url string, link_text string, context string")
    exports.export_links(links, items, jobs, 1, str(tmp_path / "one"), now())
    got = document(tmp_path / "one")
    assert (got["blog_url"], got["count"], got["exported_at"]) == ("https://a", 300, "2024-06-01T10:00:00.000Z")
    assert [i["target_url"] for i in got["items"]] == [f"t{i}" for i in range(1, 301)]
    assert got["items"][0] == {"source_url": "s", "target_url": "t1", "context": ""}
    assert got["items"][2]["link_text"] == 'l "<&>" 🎉'
    exports.export_links(links, items, jobs, 77, str(tmp_path / "none"), now())
    assert document(tmp_path / "none") == {"blog_url": "unknown", "exported_at": "2024-06-01T10:00:00.000Z", "count": 0, "items": []}


def test_failed_posts_report(spark, tmp_path):
    jobs, items = log(spark)
    exports.export_failed_posts(items, jobs, str(tmp_path / "failed"), "https://a", now())
    got = document(tmp_path / "failed")
    assert (got["blog_url"], got["count"]) == ("https://a", 2)
    assert got["items"] == [
        {"post_url": "https://a/1", "error_messages": ['say "no"', "b"]},
        {"post_url": "https://a/2", "error_messages": []},
    ]


def test_a_post_with_very_many_messages_stays_one_item(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "https://a")], "id long, blog_url string")
    rows = [(i, 1, "https://a/1", "failed", f'm"{i}') for i in range(1, 1502)]
    rows += [(2000, 1, "https://a/2", "failed", None), (2001, 1, "https://a/3", "failed", "x")]
    items = spark.createDataFrame(rows, "id long, job_id long, post_url string, status string, error_message string")
    exports.export_failed_posts(items, jobs, str(tmp_path / "failed"), "https://a", now())
    got = document(tmp_path / "failed")
    assert got["count"] == 3 == len(got["items"])
    assert got["items"][0] == {"post_url": "https://a/1", "error_messages": [f'm"{i}' for i in range(1, 1502)]}
    assert [i["error_messages"] for i in got["items"][1:]] == [[], ["x"]]
    exports.export_failed_posts(items, jobs, str(tmp_path / "none"), "https://b", now())
    assert document(tmp_path / "none")["items"] == []


def test_payloads_leave_out_missing_images(spark, tmp_path):
    rows = [("u1", [1, 2], None), ("u2", [], 7)]
    frame = spark.createDataFrame(rows, "url string, categories array<long>, featured_media long")
    exports.write_payloads(frame, str(tmp_path / "payloads"))
    got = [json.loads(line) for part in glob.glob(f"{tmp_path}/payloads/part-*") for line in open(part)]
    assert sorted(got, key=lambda r: r["url"]) == [
        {"url": "u1", "categories": [1, 2]},
        {"url": "u2", "categories": [], "featured_media": 7},
    ]


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "u"), (2, 5, "v")], "id long, job_id long, post_url string")
    for name in schemas.HISTORY:
        spark.createDataFrame([], schemas.HISTORY[name]).write.parquet(f"{tmp_path}/{name}")
    exports.append_rows("job_items", rows, now(), f"{tmp_path}/job_items")
    history = tables.read_history(spark, str(tmp_path))
    assert set(history) == set(schemas.HISTORY)
    got = history["job_items"].orderBy("id").collect()
    assert [(r.id, r.post_url, r.status, r.created_at.hour) for r in got] == [(1, "u", "running", 10), (2, "v", "running", 10)]


def test_posts_and_pages(spark, tmp_path):
    rows = [("https://a", "https://a/1", "  <p>x</p>\n ")]
    spark.createDataFrame(rows, schemas.PAGES).write.parquet(str(tmp_path / "pages"))
    pages = tables.read_pages(spark, str(tmp_path / "pages"))
    assert pages.first().html == "<p>x</p>"
    exports.write_posts(pages, str(tmp_path / "posts"))
    kept = spark.read.parquet(str(tmp_path / "posts")).filter("blog_url = 'https://a'")
    assert kept.count() == 1

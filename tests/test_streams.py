"""Streams over several micro-batches and a restart end in the same state as the batch operators."""

from pyspark.sql import functions as F

from inkferry.config import MigrationConfig
from inkferry.operators import extract, history
from inkferry.streaming import streams

ITEMS = "id long, job_id long, post_url string, status string"


def drop_in(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_retry_set_survives_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, blog_url string")
    first = [(i, 1 + i % 2, f"u{i % 7}", "failed") for i in range(40)]
    drop_in(spark, folder, first[:20], ITEMS)
    drop_in(spark, folder, first[20:], ITEMS)
    of_batch = lambda batch: streams.retry_counts(batch, jobs)
    run = lambda: streams.run_partials(source(spark, folder, ITEMS), of_batch, out, checkpoint)
    run()
    later = [(50 + i, 1, f"u{i}", "completed") for i in range(3)]
    drop_in(spark, folder, later, ITEMS)
    run()
    got = streams.due_for_retry(streams.merged(spark, [out], streams.merged_counts))
    want = history.retry_urls(spark.createDataFrame(first + later, ITEMS), jobs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_item_state_keeps_the_newest_patch(spark, tmp_path):
    schema = "id long, seq long, field string, value string"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    drop_in(spark, folder, [(1, 5, "status", "failed"), (2, 1, "status", "running")], schema)
    drop_in(spark, folder, [(1, 4, "status", "running"), (1, 6, "error_message", None)], schema)
    drop_in(spark, folder, [(2, 9, "status", "completed")], schema)
    streams.run_partials(source(spark, folder, schema), streams.item_state, out, checkpoint)
    folded = streams.compact(spark, out, streams.item_state, str(tmp_path))
    for paths in ([out], [folded], [folded, out]):
        got = streams.merged(spark, paths, streams.item_state).collect()
        assert {(r.id, r.field): r.value for r in got} == {
            (1, "status"): "failed", (1, "error_message"): None, (2, "status"): "completed",
        }


def test_new_urls_come_once(spark, tmp_path):
    schema = "blog_url string, page_no long, html string, seen_at timestamp"
    page = lambda *hrefs: "".join(f'<a class="link_category" href="{h}">p</a>' for h in hrefs)
    folder = str(tmp_path / "in")
    for n, html in enumerate((page("/1", "/2"), page("/2", "/3"), "<p></p>", page("/3", "/4", ""))):
        at = f"2024-01-01 0{n}:00:00"
        rows = spark.createDataFrame([("https://a", n + 1, html, at)], schema.replace("timestamp", "string"))
        rows.withColumn("seen_at", F.to_timestamp("seen_at")).coalesce(1).write.mode("append").parquet(folder)
    attempted = spark.createDataFrame([("https://a", "https://a/1")], "blog_url string, post_url string")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    streams.run_partials(source(spark, folder, schema), streams.listed_urls, out, checkpoint)
    fresh = streams.merged(spark, [out], lambda listed: streams.new_urls(listed, attempted))
    assert sorted(r.post_url for r in fresh.collect()) == ["https://a/2", "https://a/3", "https://a/4"]


def test_rate_usage_counts_rows_however_late(spark, tmp_path):
    schema = "blog_url string, started_at timestamp"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for times in (["10:00:10", "10:00:50"], ["20:01:10"], ["00:00:30", "10:00:20"], ["20:05:00"]):
        rows = spark.createDataFrame([("a", f"2024-01-01 {x}") for x in times], "blog_url string, started_at string")
        rows.withColumn("started_at", F.to_timestamp("started_at")).coalesce(1).write.mode("append").parquet(folder)
    of_batch = lambda batch: streams.interval_starts(batch, "1 minute")
    streams.run_partials(source(spark, folder, schema), of_batch, out, checkpoint)
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 4
    got = streams.against_cap(streams.merged(spark, [out], streams.merged_starts), 2)
    want = streams.rate_usage(spark.read.schema(schema).parquet(folder), "1 minute", 2)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("over_cap").count() == 1


def test_parsed_stream_equals_batch(spark, tmp_path):
    schema = "blog_url string, url string, html string"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [("https://a", f"https://a/{n}", f'<meta name="title" content="T{n}">') for n in range(6)]
    drop_in(spark, folder, rows[:3], schema)
    drop_in(spark, folder, rows[3:], schema)
    stream = streams.stream_parse(source(spark, folder, schema))
    streams.run_appends(stream, out, checkpoint)
    got = spark.read.schema(stream.schema).parquet(out).select("url", "title").collect()
    want = extract.parse_posts(spark.createDataFrame(rows, schema)).select("url", "title").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))

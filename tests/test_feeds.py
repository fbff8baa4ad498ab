"""Crawl frontier, change feeds, closed intervals and the retry queue: any order, restarts and replays."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkferry.operators import extract, history
from inkferry.plans.dispatch import retry_plan
from inkferry.streaming import changes, frontier, intervals, retry_queue, streams, tiers

PAGES = "blog_url string, page_no long, html string"
ITEMS = "id long, job_id long, post_url string, status string"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def links(*names):
    return "".join(f'<a class="link_category" href="/{n}">p</a>' for n in names) or "<p>none</p>"


def test_spans_cover_all_batches():
    for n in range(200):
        found = tiers.spans(n)
        assert [x for a, b in found for x in range(a, b)] == list(range(n))
        assert len(found) <= 3 * 4


def test_tiers_merge_and_can_be_written_again(spark, tmp_path):
    total = lambda df: df.groupBy("k").agg(F.sum("v").alias("v"))
    like = spark.createDataFrame([], "k string, v long")
    for batch in (*range(7), 5, 6):
        rows = spark.createDataFrame([("a", 10**batch), ("b", 1)], like.schema)
        tiers.put(rows, str(tmp_path), batch, total)
        held = dict(tiers.before(like, str(tmp_path), batch + 1, total).collect())
        assert held == {"a": sum(10**i for i in range(batch + 1)), "b": batch + 1}
    assert (tmp_path / "0-4").exists() and not (tmp_path / "4-8").exists()
    assert tiers.before(like, str(tmp_path), 0, total).count() == 0


BLOG_PAGES = [
    ("a", 1, links("a1", "a2")),
    ("a", 2, links("a3", "a1")),
    ("a", 3, links("a4")),
    ("a", 5, links("a9", "a2")),  # behind the missing page 4
    ("b", 1, links()),
    ("b", 2, links("b1")),  # behind an empty first page
    ("c", 2, links("c2")),
    ("c", 1, links("c1")),
    ("c", 3, links()),
    ("c", 4, links("c4")),
]
REACHABLE = [("a", f"a/a{n}") for n in (1, 2, 3, 4)] + [("c", "c/c1"), ("c", "c/c2")]


@pytest.mark.parametrize("seed", range(3))
def test_frontier_in_any_order(spark, tmp_path, seed):
    rows = list(BLOG_PAGES)
    random.Random(seed).shuffle(rows)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    seen = []
    for n, batch in enumerate((rows[:3], rows[3:6], rows[6:])):
        put(spark, folder, batch, PAGES)
        frontier.run_frontier(source(spark, folder, PAGES), out, checkpoint)
        seen += batch
        want = extract.discover_post_urls(spark.createDataFrame(seen, PAGES)).select("blog_url", "post_url")
        got = frontier.released(spark, out)
        assert sorted(got.select("blog_url", "post_url").collect()) == sorted(want.collect()), n  # each once
    assert sorted(map(tuple, got.select("blog_url", "post_url").collect())) == REACHABLE
    put(spark, folder, [("a", 4, links("a5")), ("b", 1, links("b0"))], PAGES)
    frontier.run_frontier(source(spark, folder, PAGES), out, checkpoint)
    opened = frontier.released(spark, out).filter("batch_id = 3").select("post_url").collect()
    assert sorted(r.post_url for r in opened) == ["a/a5", "a/a9", "b/b0", "b/b1"]


@pytest.mark.parametrize(
    "pages, end",
    [
        (range(1, 32_769), 32_769),
        (range(1, 70_000), 70_000),
        (itertools.chain(range(1, 32_769), range(32_770, 40_000)), 32_769),
        ([*range(1, 32_768), *range(32_769, 32_800)], 32_768),
        ([1, 2, 3, 4, 5, 6, 7, 8, 10], 9),
        ([*range(1, 17), 18], 17),
        ([2, 3], 1),
        ([40_000], 1),
    ],
)
def test_end_of_a_long_blog(spark, pages, end):
    rows = spark.createDataFrame([("a", p, ["/x"]) for p in pages], "blog_url string, page_no long, hrefs array<string>")
    halves = [frontier.page_marks(rows.filter(F.col("page_no") % 2 == n)) for n in (0, 1)]
    marks = frontier.merged_marks(halves[0].unionByName(halves[1]))
    assert [tuple(r) for r in frontier.blog_ends(marks).collect()] == [("a", end)]


def test_retry_changes_add_up(spark, tmp_path):
    rng = random.Random(2)
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, blog_url string")
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows, post = [], ["blog_url", "post_url"]
    for n in range(6):
        batch = [(100 * n + i, rng.randrange(1, 4), f"u{rng.randrange(8)}", rng.choice(["failed", "failed", "completed", "running"])) for i in range(8)]
        put(spark, folder, batch, ITEMS)
        changes.run_changes(
            source(spark, folder, ITEMS),
            lambda df: streams.retry_counts(df, jobs),
            streams.merged_counts,
            post,
            out,
            checkpoint,
            streams.due_for_retry,
        )
        before = {tuple(r) for r in history.retry_urls(spark.createDataFrame(rows, ITEMS), jobs).collect()}
        rows += batch
        after = {tuple(r) for r in history.retry_urls(spark.createDataFrame(rows, ITEMS), jobs).collect()}
        feed = changes.changes(spark, out)
        made = {(r.blog_url, r.post_url, r.change) for r in feed.filter(F.col("batch_id") == n).collect()}
        assert made == {(*k, "entered") for k in after - before} | {(*k, "left") for k in before - after}
        assert {tuple(r) for r in changes.current(feed, post).collect()} == after


def test_differences_of_values(spark):
    schema = "id long, value string"
    was = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "x")], schema)
    now = spark.createDataFrame([(1, "b"), (2, None), (4, None), (None, "y")], schema)
    found = {(r.id, r.change, r.old and r.old.value, r.new and r.new.value) for r in changes.differences(was, now, ["id"]).collect()}
    assert found == {(1, "changed", "a", "b"), (3, "left", "c", None), (4, "entered", None, None), (None, "changed", "x", "y")}


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_closed_intervals_and_corrections(spark, tmp_path):
    schema = "blog_url string, started_at timestamp"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [
        [("a", at(1)), ("a", at(9)), ("b", at(3)), ("a", None)],
        [("a", at(25)), ("a", at(2))],  # 0-10 closes with this batch, and counts its row
        [("a", at(4)), ("b", at(12)), ("a", at(26))],  # two rows are late
        [("c", at(60))],
    ]
    for batch in batches:
        put(spark, folder, batch, schema)
        intervals.run_closed_intervals(source(spark, folder, schema), "10 minutes", "5 minutes", out, checkpoint)
    rows = lambda df: sorted((r.blog_url, r.interval_start, r.starts, r.batch_id) for r in df.collect())
    assert rows(intervals.closed(spark, out)) == [("a", at(0), 3, 1), ("a", at(20), 2, 3), ("b", at(0), 1, 1)]
    assert rows(intervals.corrections(spark, out)) == [("a", at(0), 1, 2), ("b", at(10), 1, 2)]
    left = intervals.still_open(spark, out, "10 minutes", "5 minutes", 4)
    total = streams.merged_starts(
        intervals.closed(spark, out).unionByName(intervals.corrections(spark, out)).drop("batch_id").unionByName(left)
    )
    want = streams.interval_starts(spark.createDataFrame([r for b in batches for r in b], schema), "10 minutes")
    assert sorted(total.collect()) == sorted(want.select(total.columns).collect())


def second(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_retry_queue_comes_due_across_a_restart(spark, tmp_path):
    schema = "id long, blog_url string, post_url string, status string, at timestamp"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [
        [(1, "a", "u1", "failed", second(0)), (2, "a", "u2", "failed", second(0)), (3, "a", "u3", "failed", second(0)), (4, "a", "u3", "completed", second(0))],
        [(5, "a", "u1", "failed", second(10)), (6, "a", "u4", "failed", second(12)), (7, "a", "u2", "running", second(12))],
        [(8, "a", "u3", "failed", second(13)), (9, "a", "u1", "failed", second(13)), (10, "a", "u5", "failed", second(20))],
    ]
    due = []
    for batch in batches:
        put(spark, folder, batch, schema)
        queue = retry_queue.retry_queue(source(spark, folder, schema), 3, 500, 4000, 10)
        retry_queue.run_retry_queue(queue, out, checkpoint)
        events = spark.read.schema(retry_queue.OUTPUT).parquet(out)
        due.append(sorted((r.post_url, r.n) for r in events.filter("event = 'sent'").collect()))
    # u1 and u2 come due once the log is past their delay; u1 fails again before its second delay is over
    assert due == [[], [("u1", 1), ("u2", 1)], [("u1", 1), ("u2", 1), ("u4", 1)]]
    state = {r.post_url: (r.n, r.event, r.delay_ms) for r in retry_queue.queue_state(spark, out).collect()}
    assert state == {"u1": (3, "exhausted", None), "u2": (1, "sent", 500), "u4": (1, "sent", 500), "u5": (1, "queued", 500)}
    log = spark.createDataFrame([("a", p, n) for p, (n, _, _) in state.items()], "blog_url string, post_url string, n long")
    plan = {r.post_url: (r.exhausted, r.delay_ms) for r in retry_plan(log, 3, 500, 4000, 10).collect()}
    assert plan == {p: (e == "exhausted", d) for p, (_, e, d) in state.items()}


def test_delays_equal_the_plan(spark):
    log = spark.createDataFrame([("a", "u", n) for n in range(1, 9)], "blog_url string, post_url string, n long")
    plan = {r.n: r.delay_ms for r in retry_plan(log, 100, 700, 90_000, 2.5).collect()}
    assert plan == {n: retry_queue.delay_after(n, 700, 90_000, 2.5) for n in plan}
    with pytest.raises(ValueError):
        retry_queue.RetryQueue(0, 1, 1, 1)


def test_retry_events_follow_from_the_times(spark, tmp_path):
    """Against a plain queue: posts with nulls, failures without a time, rows that come late, batch by batch."""
    rng, most, delays = random.Random(5), 3, (500, 4000, 10)
    schema = "id long, blog_url string, post_url string, status string, at timestamp"
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    state, want, newest, number = {}, [], None, 0
    for n in range(5):
        batch = []
        for _ in range(60):
            when = None if rng.random() < 0.05 else second(3 * n + rng.randrange(-1, 4)).replace(microsecond=rng.randrange(1, 1000) * 1000)
            status = rng.choice(["failed", "failed", "failed", "completed", "running"])
            batch.append((number, rng.choice(["a", "b", None]), rng.choice([*(f"u{i}" for i in range(9)), None]), status, when))
            number += 1
        put(spark, folder, batch, schema)
        queue = retry_queue.retry_queue(source(spark, folder, schema), most, *delays)
        retry_queue.run_retry_queue(queue, out, checkpoint)
        ms = lambda t: None if t is None else round((t - second(0)).total_seconds() * 1000)
        for _, blog, post, status, when in sorted(batch, key=lambda r: (r[4] is None, r[4] or second(0), r[0])):
            if status == "running" or (newest is not None and when is not None and ms(when) <= newest):
                continue
            failures, done, due = state.get((blog, post), (0, False, None))
            if done:
                continue
            if due is not None and when is not None and due <= ms(when):
                want.append((blog, post, failures, "sent", retry_queue.delay_after(failures, *delays)))
            failures, done, due = failures + (status == "failed"), status == "completed", None
            over = failures >= most
            delay = None if done or over else retry_queue.delay_after(failures, *delays)
            if delay is not None and when is not None:
                due = ms(when) + delay
            want.append((blog, post, failures, "completed" if done else "exhausted" if over else "queued", delay))
            state[blog, post] = failures, done, due
        newest = max([ms(r[4]) for r in batch if r[4] is not None] + ([] if newest is None else [newest]))
        for key, (failures, done, due) in list(state.items()):
            if due is not None and due <= newest:
                want.append((*key, failures, "sent", retry_queue.delay_after(failures, *delays)))
                state[key] = failures, done, None
        events = spark.read.schema(retry_queue.OUTPUT).parquet(out)
        got = [tuple(r) for r in events.select("blog_url", "post_url", "n", "event", "delay_ms").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), n

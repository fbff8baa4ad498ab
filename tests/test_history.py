import pytest

from inkferry import schemas
from inkferry.operators import history

A, B = "https://blog-a.example", "https://blog-b.example"


def jobs(spark, *rows):
    return spark.createDataFrame(rows, "id long, blog_url string, job_type string, status string")


def items(spark, *rows):
    return spark.createDataFrame(
        rows, "id long, job_id long, post_url string, status string, error_message string"
    )


def urls(frame):
    return sorted(r.post_url for r in frame.collect())


@pytest.fixture
def two_blogs(spark):
    return jobs(spark, (1, A, "single", "running"), (2, A, "single", "running"), (3, B, "single", "running"))


def test_attempted_urls_are_distinct_per_blog(spark, two_blogs):
    log = items(
        spark,
        (1, 1, "https://a/1", "running", None),
        (2, 2, "https://a/1", "running", None),
        (3, 2, "https://a/2", "running", None),
        (4, 3, "https://b/1", "running", None),
    )
    assert urls(history.attempted_urls(log, two_blogs, A)) == ["https://a/1", "https://a/2"]
    assert urls(history.attempted_urls(log, two_blogs, B)) == ["https://b/1"]
    assert urls(history.attempted_urls(log, two_blogs, "https://none")) == []


def test_retry_needs_a_failure_and_no_completion(spark, two_blogs):
    log = items(
        spark,
        (1, 1, "https://a/failed", "failed", "x"),
        (2, 1, "https://a/recovered", "failed", "x"),
        (3, 2, "https://a/recovered", "completed", None),
        (4, 2, "https://a/done", "completed", None),
        (5, 2, "https://a/open", "running", None),
        (6, 3, "https://b/failed", "failed", "x"),
    )
    assert urls(history.retry_urls(log, two_blogs, A)) == ["https://a/failed"]
    assert urls(history.retry_urls(log, two_blogs, B)) == ["https://b/failed"]
    assert urls(history.stuck_urls(log, two_blogs)) == ["https://a/open"]
    assert urls(history.unresolved_failures(log, two_blogs)) == ["https://a/failed", "https://b/failed"]


def test_success_on_another_blog_does_not_count(spark, two_blogs):
    log = items(spark, (1, 1, "https://x/1", "failed", "m"), (2, 3, "https://x/1", "completed", None))
    assert urls(history.unresolved_failures(log, two_blogs)) == ["https://x/1"]


def test_report_messages_are_distinct_in_first_seen_order(spark, two_blogs):
    log = items(
        spark,
        (1, 1, "https://a/2", "failed", "second"),
        (2, 1, "https://a/1", "failed", "b"),
        (3, 2, "https://a/1", "failed", "a"),
        (4, 2, "https://a/1", "failed", "b"),
        (5, 2, "https://a/3", "failed", None),
        (6, 2, "https://a/4", "failed", ""),
    )
    rows = sorted(history.failed_posts_report(log, two_blogs, A).collect(), key=lambda r: (r.first_id, r.n))
    assert [(r.post_url[-1], r.first_id, r.n, r.error_message) for r in rows] == [
        ("2", 1, 1, "second"), ("1", 2, 1, "b"), ("1", 2, 2, "a"), ("3", 5, 0, None), ("4", 6, 0, None),
    ]


def test_report_numbers_messages_of_a_hot_post(spark, two_blogs, all_hot):
    log = items(spark, *[(i, 1, "https://a/1", "failed", f"m{i:03d}") for i in range(1, 251)])
    rows = sorted(history.failed_posts_report(log, two_blogs).collect(), key=lambda r: r.n)
    assert [(r.n, r.error_message) for r in rows] == [(i, f"m{i:03d}") for i in range(1, 251)]


def test_skipped_posts_belong_to_the_newest_running_full_job(spark):
    found = jobs(spark, (1, A, "full", "running"), (2, A, "full", "running"), (3, A, "retry", "running"), (4, B, "full", "failed"))
    skipped = spark.createDataFrame([(A, 7), (B, 1)], "blog_url string, skipped long")
    assert [tuple(r) for r in history.skipped_of_jobs(skipped, found).collect()] == [(2, 7)]


def test_summary_counts_and_empty_jobs(spark, two_blogs):
    log = items(
        spark,
        (1, 1, "https://a/1", "failed", "x"),
        (2, 1, "https://a/2", "completed", None),
        (3, 1, "https://a/3", "running", None),
    )
    skipped = spark.createDataFrame([(1, 9)], "job_id long, skipped long")
    found = {r.job_id: r for r in history.job_summary(two_blogs, log, skipped).collect()}
    one = found[1]
    assert (one.detected, one.completed, one.failed, one.processed, one.skipped) == (3, 1, 1, 2, 9)
    assert (found[2].detected, found[2].skipped) == (0, 0)


def test_latest_running_job_is_the_highest_id(spark):
    log = jobs(spark, (1, A, "full", "running"), (2, A, "full", "running"), (3, A, "full", "failed"), (4, A, "retry", "running"))
    got = {(r.job_type, r.blog_url): r.id for r in history.latest_running_job(log).collect()}
    assert got == {("full", A): 2, ("retry", A): 4}


def test_attempts_are_numbered_by_id(spark, two_blogs, all_hot):
    log = items(spark, *[(i * 7, 1 + i % 2, f"https://a/{i % 3}", "failed", None) for i in range(300)])
    got = {r.id: r.attempt for r in history.attempt_numbers(log, two_blogs).collect()}
    assert got == {i * 7: i // 3 + 1 for i in range(300)}


def test_links_by_job_and_item_and_dangling(spark):
    log = items(spark, (1, 10, "u", "running", None), (2, 20, "v", "running", None))
    links = spark.createDataFrame(
        [(1, 1, "s", "t1", "", None), (2, 1, "s", "t1", "a", "🎉"), (3, 2, "s", "t2", None, "")],
        "id long, job_item_id long, source_url string, target_url string, link_text string, context string",
    )
    assert sorted(r.id for r in history.links_by_job(links, log, 10).collect()) == [1, 2]
    assert sorted(r.id for r in history.links_by_job(links, log).collect()) == [1, 2, 3]
    assert history.links_by_item(links, 999).count() == 0
    post_map = spark.createDataFrame([("t1", 5)], "post_url string, dest_post_id long")
    got = {r.id: (r.dest_post_id, r.dangling) for r in history.resolve_links(links, post_map).collect()}
    assert got == {1: (5, False), 2: (5, False), 3: (None, True)}


def test_invariants_between_the_sets(spark):
    from inkferry.catalog.fixtures import Tables
    from tests.conftest import SMALL

    t = Tables(spark, SMALL)
    log, runs = t.view("job_items"), t.view("post_jobs")
    attempted = set(map(tuple, history.attempted_urls(log, runs).collect()))
    retry = set(map(tuple, history.retry_urls(log, runs).collect()))
    stuck = set(map(tuple, history.stuck_urls(log, runs).collect()))
    failures = {(r.blog_url, r.post_url) for r in history.unresolved_failures(log, runs).collect()}
    states = history.url_states(log, runs)
    done = {(r.blog_url, r.post_url) for r in states.filter("completed > 0").collect()}
    assert failures == retry
    assert retry | stuck | done == attempted
    assert len(retry) + len(stuck) + len(done) == len(attempted)


def test_schemas_name_every_checked_column():
    for table, columns in schemas.NOT_NULL.items():
        names = [f.split(" ")[0] for f in schemas.HISTORY[table].split(", ")]
        assert set(columns) <= set(names)


def test_a_hot_job_is_split_adaptively(spark, tmp_path):
    """The join of items and jobs stays a plain shuffle join that adaptive execution can split."""
    rows = spark.range(400_000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50000 END AS job_id", "concat('https://a/', id) AS post_url",
        "CASE WHEN id % 2 = 0 THEN 'failed' ELSE 'running' END AS status",
    )
    rows.repartition(16).write.parquet(str(tmp_path / "items"))
    spark.range(50_000).selectExpr("id", "'https://a' AS blog_url").write.parquet(str(tmp_path / "jobs"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        items_, jobs_ = spark.read.parquet(str(tmp_path / "items")), spark.read.parquet(str(tmp_path / "jobs"))
        found = history.retry_urls(items_, jobs_)
        assert len(found.collect()) == 200_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

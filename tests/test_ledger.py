import random

import pytest
from pyspark.sql import functions as F

from inkferry.operators import ledger


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def inserted_one_by_one(mapped, new):
    urls, ids, accepted = {u for u, _ in mapped}, {d for _, d in mapped}, []
    for row_id, url, dest in sorted(new):
        if url not in urls and dest not in ids:
            accepted.append(row_id)
            urls.add(url)
            ids.add(dest)
    return accepted


@pytest.mark.parametrize("seed", range(3))
def test_extend_post_map_equals_single_inserts(spark, seed):
    rng = random.Random(seed)
    mapped = [(f"u{i}", i) for i in range(3)]
    new = [(i, f"u{rng.randrange(25)}", rng.randrange(25)) for i in range(1, 61)]
    accepted, rejected = ledger.extend_post_map(
        spark.createDataFrame(mapped, "post_url string, dest_post_id long"),
        spark.createDataFrame(new, "id long, post_url string, dest_post_id long"),
    )
    want = inserted_one_by_one(mapped, new)
    assert sorted(r.id for r in accepted.collect()) == want
    assert sorted(r.id for r in rejected.collect()) == sorted({n[0] for n in new} - set(want))
    assert all(r.reason for r in rejected.collect())


@pytest.mark.parametrize("group_rows", [100_000, 3])
def test_long_chain_of_clashes(spark, monkeypatch, group_rows):
    monkeypatch.setattr(ledger, "GROUP_ROWS", group_rows)
    length = 1000 if group_rows > 3 else 12
    new = [(i, f"u{(i + 1) // 2}", i // 2) for i in range(length)]  # each row clashes with the one before
    accepted, rejected = ledger.extend_post_map(
        spark.createDataFrame([], "post_url string, dest_post_id long"),
        spark.createDataFrame(new, "id long, post_url string, dest_post_id long"),
    )
    assert sorted(r.id for r in accepted.collect()) == inserted_one_by_one([], new)
    assert rejected.count() == length - len(inserted_one_by_one([], new))


def test_errors_become_patches(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, blog_url string")
    items = spark.createDataFrame(
        [(1, 1, "u", "failed"), (2, 1, "u", "running"), (3, 2, "u", "running"), (4, 1, "v", "running")],
        "id long, job_id long, post_url string, status string",
    )
    errors = spark.createDataFrame([("a", "u", "bad"), ("a", "none", "x")], "blog_url string, url string, message string")
    got = ledger.failure_patches(errors, items, jobs, F.lit(5)).collect()
    assert sorted(map(tuple, got)) == [(2, 5, "error_message", "bad"), (2, 5, "status", "failed")]


def test_rejected_row_blocks_nothing(spark):
    new = [(1, "a", 1), (2, "b", 1), (3, "b", 2)]
    accepted, rejected = ledger.extend_post_map(
        spark.createDataFrame([], "post_url string, dest_post_id long"),
        spark.createDataFrame(new, "id long, post_url string, dest_post_id long"),
    )
    assert sorted(r.id for r in accepted.collect()) == [1, 3]
    assert [(r.id, r.reason) for r in rejected.collect()] == [(2, "dest_post_id already mapped")]


def test_rows_without_a_key_are_rejected_by_themselves(spark):
    new = [(1, "a", None), (2, "b", None), (3, None, 1), (4, None, None), (5, "a", 1)]
    accepted, rejected = ledger.extend_post_map(
        spark.createDataFrame([], "post_url string, dest_post_id long"),
        spark.createDataFrame(new, "id long, post_url string, dest_post_id long"),
    )
    assert [tuple(r) for r in accepted.collect()] == [(5, "a", 1)]
    assert sorted((r.id, r.reason) for r in rejected.collect()) == [
        (1, "dest_post_id is null"),
        (2, "dest_post_id is null"),
        (3, "post_url is null"),
        (4, "post_url is null"),
    ]


def test_patches_set_only_what_they_name(spark):
    rows = spark.createDataFrame(
        [(1, "running", None, "old"), (2, "running", 7, "keep")],
        "id long, status string, dest_post_id long, error_message string",
    ).withColumn("updated_at", now())
    patches = spark.createDataFrame(
        [
            (1, 1, "status", "failed"),
            (1, 2, "status", "completed"),
            (1, 3, "dest_post_id", "123"),
            (1, 4, "error_message", None),
            (1, 5, "updated_at", "2024-07-01 10:00:00"),
        ],
        "id long, seq long, field string, value string",
    )
    got = {r.id: r for r in ledger.apply_patches("job_items", rows, patches).collect()}
    assert (got[1].status, got[1].dest_post_id, got[1].error_message) == ("completed", 123, None)
    assert got[1].updated_at.isoformat() == "2024-07-01T10:00:00"
    assert (got[2].status, got[2].dest_post_id, got[2].error_message) == ("running", 7, "keep")


def test_new_rows_get_ids_and_defaults(spark):
    existing = spark.createDataFrame([(41,)], "id long")
    new = spark.createDataFrame([(5, f"u{i}") for i in range(4)], "job_item_id long, image_url string")
    rows = ledger.new_history_rows("image_assets", ledger.assign_ids(new, ["image_url"], existing), now())
    got = sorted(rows.collect(), key=lambda r: r.id)
    assert [(r.id, r.image_url, r.status, r.dest_media_id) for r in got] == [
        (42 + i, f"u{i}", "pending", None) for i in range(4)
    ]
    first = ledger.assign_ids(new, ["image_url"], existing.filter("id < 0"))
    assert sorted(r.id for r in first.collect()) == [1, 2, 3, 4]


def test_cascade_removes_children_and_keeps_the_map(spark, all_hot):
    history = {
        "post_jobs": spark.createDataFrame([(1,), (2,)], "id long"),
        "job_items": spark.createDataFrame([(10, 1), (20, 2)], "id long, job_id long"),
        "image_assets": spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id long, job_item_id long"),
        "internal_links": spark.createDataFrame([(1, 20)], "id long, job_item_id long"),
        "post_map": spark.createDataFrame([(1,)], "id long"),
    }
    kept = ledger.cascade_delete(history, spark.createDataFrame([(1,)], "job_id long"))
    assert {n: [r.id for r in d.collect()] for n, d in kept.items()} == {
        "post_jobs": [2], "job_items": [20], "image_assets": [3], "internal_links": [1], "post_map": [1],
    }


def test_violations_are_listed(spark):
    history = {
        "post_jobs": spark.createDataFrame([(1, None, "full", "done")], "id long, blog_url string, job_type string, status string"),
        "job_items": spark.createDataFrame([(5, -1, "u", "failed"), (6, 1, None, "failed")], "id long, job_id long, post_url string, status string"),
        "post_map": spark.createDataFrame([(1, "u", 1), (2, "u", 2), (3, "v", 2)], "id long, post_url string, dest_post_id long"),
    }
    got = {tuple(r) for r in ledger.constraint_violations(history).collect()}
    assert got == {
        ("blog_url not null", "post_jobs", "1", 1),
        ("status allowed", "post_jobs", "1", 1),
        ("post_url not null", "job_items", "6", 1),
        ("job_id refers to post_jobs", "job_items", "5", 1),
        ("post_url unique", "post_map", "u", 2),
        ("dest_post_id unique", "post_map", "2", 2),
    }

import random

from pyspark.sql import functions as F

from inkferry.operators import skew


def test_hot_keys_are_found_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 50)
    rows = [("hot", i) for i in range(400)] + [(None, i) for i in range(90)] + [(f"k{i % 60}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v long")
    found = {r.k: r["_salts"] for r in skew.hot_keys(df, ["k"]).collect()}
    assert found == {"hot": 8, None: 2}  # the salts grow with the key
    assert skew.hot_keys(df.filter("k LIKE 'k%'"), ["k"]).isEmpty()
    monkeypatch.setattr(skew, "MOST_HOT_KEYS", 4)  # no key with less than a quarter of the rows
    assert [r.k for r in skew.hot_keys(df, ["k"]).collect()] == ["hot"]


def test_skew_join_spreads_a_hot_key_and_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 50)
    rows = [("hot", i) for i in range(400)] + [(None, i) for i in range(400, 500)] + [("cold", 500), ("lone", 501)]
    left = spark.createDataFrame(rows, "k string, v long")
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("unused", 3)], "k string, w long")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = sorted(map(tuple, skew.skew_join(left, right, ["k"], how, "v").collect()), key=str)
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
        assert got == want, how


def test_number_within_crosses_blocks(spark, all_hot):
    rng = random.Random(7)
    rows = [(rng.choice("aab"), i) for i in rng.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "k string, id long")
    got = skew.number_within(df, ["k"], ["id"], "n", block=F.floor(F.col("id") / 100)).collect()
    for key in "ab":
        ids = sorted(i for k, i in rows if k == key)
        assert {(r.id, r.n) for r in got if r.k == key} == {(i, n + 1) for n, i in enumerate(ids)}


def test_numbers_have_one_type_with_and_without_hot_keys(spark, monkeypatch):
    rows = [("a", i) for i in range(20)] + [(None, i) for i in range(20)] + [("b", 1)]
    df = spark.createDataFrame(rows, "k string, id long")
    block = F.floor(F.col("id") / 3)
    plain = skew.number_within(df, ["k"], ["id"], "n", block)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 5)
    split = skew.number_within(df, ["k"], ["id"], "n", block)
    assert dict(plain.dtypes)["n"] == dict(split.dtypes)["n"] == "bigint"
    assert sorted(plain.collect(), key=str) == sorted(split.collect(), key=str)


def test_number_rows_is_dense_and_ordered(spark):
    rows = [(f"u{i % 37:02d}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "u string, id long").repartition(7)
    got = skew.number_rows(df, ["u", "id"], "n").collect()
    assert [(r.u, r.id) for r in sorted(got, key=lambda r: r.n)] == sorted(rows)
    assert sorted(r.n for r in got) == list(range(1, 5001))


def test_number_sorted_within_by_text(spark, all_hot):
    rows = [("a", f"https://a/{i}") for i in range(300)] + [("b", "https://b/1")]
    df = spark.createDataFrame(rows, "blog string, url string")
    got = skew.number_sorted_within(df, ["blog"], ["url"], "n", "url").collect()
    ordered = [r.url for r in sorted(got, key=lambda r: r.n) if r.blog == "a"]
    assert ordered == sorted(u for b, u in rows if b == "a")


def test_checkpoint_folder_comes_from_the_session(spark):
    assert skew.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def relations(df):
    """Leaves of the optimized plan: how often a table is read."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line or "LogicalRDD" in line or "LocalRelation" in line for line in plan.split("\n"))


def test_history_plans_read_their_inputs_once(spark):
    import __spark_entry__ as entry_point
    from tests.conftest import SMALL

    built = {name: relations(entry_point.queries()[name](spark, SMALL)) for name in (
        "unresolved_failures", "failed_posts_report", "attempt_numbers", "cascade_delete"
    )}
    # the views of the jobs read the items once more
    assert built["unresolved_failures"] <= 4 and built["attempt_numbers"] <= 2, built
    assert built["failed_posts_report"] <= 8 and built["cascade_delete"] <= 12, built

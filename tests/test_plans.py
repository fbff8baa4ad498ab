import pytest

from inkferry.plans import dispatch


def test_dispatch_slots_and_lanes(spark, all_hot):
    rows = [("a", f"a/{n}", n) for n in range(7)] + [("b", "b/0", 0)]
    urls = spark.createDataFrame(rows, "blog_url string, post_url string, seq long")
    plan = dispatch.dispatch_plan(urls, 2, 1000, 3, ["seq"], block=urls["seq"]).orderBy("blog_url", "n").collect()
    assert [(r.n, r.slot, r.start_ms, r.lane) for r in plan if r.blog_url == "a"] == [
        (n + 1, n // 2, n // 2 * 1000, n % 3) for n in range(7)
    ]
    assert [(r.n, r.slot) for r in plan if r.blog_url == "b"] == [(1, 0)]
    by_text = dispatch.dispatch_plan(urls, 2, 1000, 3, ["post_url"]).orderBy("blog_url", "n").collect()
    assert [tuple(r) for r in by_text] == [tuple(r) for r in plan]
    with pytest.raises(ValueError):
        dispatch.dispatch_plan(urls, 0, 1000, 1, ["seq"])


def delays(spark, n, **options):
    frame = spark.createDataFrame([("a", f"u{i}", i) for i in range(1, n + 1)], "blog_url string, post_url string, n long")
    settings = {"max_attempts": 10, "initial_ms": 500, "max_ms": 4000, "multiplier": 2} | options
    rows = dispatch.retry_plan(frame, **settings).orderBy("n").collect()
    return [None if r.exhausted else r.delay_ms for r in rows]


def step_by_step(n, max_attempts, initial, cap, factor):
    out, delay = [], initial
    for attempt in range(1, n + 1):
        out.append(None if attempt >= max_attempts else int(delay))
        delay = min(delay * factor, cap)
    return out


@pytest.mark.parametrize("initial, cap, factor", [(500, 4000, 2), (500, 600_000, 10), (9000, 4000, 2), (300, 1000, 1), (100, 9999, 1.5)])
def test_retry_delays_equal_the_loop(spark, initial, cap, factor):
    got = delays(spark, 7, max_attempts=6, initial_ms=initial, max_ms=cap, multiplier=factor)
    assert got == step_by_step(7, 6, initial, cap, factor)


def test_retry_needs_an_attempt(spark):
    with pytest.raises(ValueError):
        delays(spark, 1, max_attempts=0)

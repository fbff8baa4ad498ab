"""Templates, aliases, token overlap, converters, outcomes and the bucketed post table."""

import collections
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from inkferry.operators import aliases, content, ledger, overlap, templates, terms
from inkferry.sources import exports
from inkferry.streaming import outcomes, streams


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_templates_name_most_failures(spark):
    messages = [f"HTTP {code} for /post/{i}" for code in (500, 404) for i in range(40)]
    messages += [f"timeout of {i}ms exceeded" for i in range(30)]
    messages += ["socket hang up"] * 25 + [None, "", "  "] + ["one of a kind", "odd"]
    items = spark.createDataFrame([("failed", m) for m in messages] + [("completed", "x")], "status string, error_message string")
    found = rows(templates.failure_templates(items), "template", "items", "messages", "named")
    assert ("HTTP 404 for <*>", 40, 40, True) in found and ("HTTP 500 for <*>", 40, 40, True) in found
    assert ("timeout of <*> exceeded", 30, 30, True) in found and ("socket hang up", 25, 1, True) in found
    assert ("", 3, 2, False) in found  # null counts as ''
    assert sum(n for _, n, _, named in found if named) >= 0.9 * len(messages)
    assert sum(n for _, n, _, _ in found) == len(messages)
    assert templates.failure_templates(items.limit(0)).count() == 0


def test_values_split_only_when_few(spark):
    texts = [f"a{i} b{i % 3}" for i in range(30)]
    messages = spark.createDataFrame([(t,) for t in texts], "error_message string")
    split = templates.learned_templates(messages, most_values=3)
    assert {r.template for r in split.collect()} == {"<*> b0", "<*> b1", "<*> b2"}
    whole = templates.learned_templates(messages, most_values=2)
    assert {r.template for r in whole.collect()} == {"<*> <*>"}


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://a.example/p/", "a.example/p"),
        ("HTTP://A.Example:80/P//#x", "a.example/P"),
        ("https://a.example", "a.example"),
        ("https://a.example/?q=1#f", "a.example?q=1"),
        ("https://a.example/p/?", "a.example/p"),
        ("https://a.example:8080/p", "a.example:8080/p"),
        ("mailto:A@b", "mailto:A@b"),
        ("", ""),
        (None, None),
    ],
)
def test_address_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(aliases.address_key(F.col("u"))).first()[0] == key


def test_links_resolve_through_aliases(spark):
    post_map = spark.createDataFrame(
        [(i, f"https://a.example/{i}", 100 + i) for i in range(20)] + [(50, "http://a.example/3/", 999)],
        "id long, post_url string, dest_post_id long",
    )
    moves = [(f"https://a.example/old/{i}", f"https://a.example/new/{i}") for i in range(20)]
    moves += [(f"http://a.example/new/{i}/", f"https://a.example/{i}") for i in range(20)]
    moves += [("https://a.example/x", "https://a.example/y"), ("https://a.example/y", "https://a.example/x"), (None, "https://a.example/z")]
    redirects = spark.createDataFrame(moves, "from_url string, to_url string")
    forms = ["https://a.example/{}", "http://a.example/{}/", "https://A.example/{}#f", "https://a.example/old/{}/", "https://a.example/new/{}?"]
    targets = [(f.format(i), 100 + i) for f in forms for i in range(20)]
    targets += [("https://a.example/x", None), (None, None), ("https://b.example/1", None)]
    links = spark.createDataFrame([(n, t, "c") for n, (t, _) in enumerate(targets)], "id long, target_url string, class string")
    found = {r.id: r for r in aliases.resolve_aliased_links(links.drop("class"), post_map, redirects).collect()}
    for n, (target, dest) in enumerate(targets):
        want = 999 if target == "http://a.example/3/" else dest  # its own entry comes first
        assert (found[n].dest_post_id, found[n].dangling) == (want, want is None), target
    assert len(found) == len(targets)
    resolved = sum(not r.dangling for r in found.values())
    assert resolved >= 0.95 * len(targets)


def test_overlap_sees_replaced_words(spark):
    docs = spark.createDataFrame(
        [(1, "a b b c", "a b d e"), (2, None, "x"), (3, "x", None), (4, "", ""), (5, "\u00e9 \u00e9\u00a0 \u00e9", "\u00e9")],
        "id long, before string, after string",
    )
    found = overlap.token_overlap(docs, "id", "before", "after")
    got = [(r.id, r.n_before, r.n_after, r.n_common, r.kept, [tuple(w) for w in r.lost]) for r in found.orderBy("id").collect()]
    assert got == [
        (1, 4, 4, 2, 0.5, [("b", 1), ("c", 1)]),
        (2, 0, 1, 0, 1.0, []),
        (3, 1, 0, 0, 0.0, [("x", 1)]),
        (4, 0, 0, 0, 1.0, []),
        (5, 3, 1, 1, 1 / 3, [("\u00e9", 1), ("\u00e9\u00a0", 1)]),
    ]


def test_converters_of_the_caller(spark):
    @F.arrow_udf("string")
    def shout(text: pa.Array) -> pa.Array:
        return pc.utf8_upper(text)

    @F.arrow_udf("string")
    def quoted(text: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise("<q>", text, "</q>", "")

    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, ""), (3, None)], "id long, html string")
    one = content.convert_html(pages, shout)
    two = content.convert_html(pages, shout, quoted, out="html")
    assert rows(one, "id", "content") == [(1, "<P>A</P>"), (2, ""), (3, None)]
    assert rows(two, "id", "html") == [(1, "<q><P>A</P></q>"), (2, ""), (3, None)]


def test_outcomes_are_settled_once(spark, tmp_path):
    items = spark.createDataFrame([(i, f"u{i % 6}") for i in range(10)], "id long, post_url string")
    start = spark.createDataFrame([(900, "u5", 5000)], "id long, post_url string, dest_post_id long")
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [
        [(0, 1, "completed", 100, None), (1, 2, "failed", None, "HTTP 500"), (77, 3, "failed", None, "x"), (2, 4, "lost", None, None)],
        [(6, 5, "completed", 106, None), (5, 6, "completed", 105, None), (3, 7, "completed", None, None), (0, 1, "completed", 100, None)],
        [(1, 8, "running", None, None), (1, 9, "completed", 101, None), (4, 10, "completed", 100, None), (2, 11, None, None, None)],
    ]

    def everything():
        return (
            rows(outcomes.mapped(spark, out, 3), "id", "post_url", "dest_post_id"),
            rows(outcomes.refused(spark, out), "id", "seq", "reason", "batch_id"),
            rows(outcomes.patches(spark, out), "id", "seq", "field", "value"),
        )

    for batch in batches:
        spark.createDataFrame(batch, outcomes.OUTCOME).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(outcomes.OUTCOME).parquet(folder)
        outcomes.run_outcomes(stream, items, start, out, checkpoint)
    mapped, refused, patches = everything()
    assert mapped == [(0, "u0", 100), (1, "u1", 101)]
    assert refused == [
        (2, 11, outcomes.BAD_STATUS, 2),
        (2, 4, outcomes.BAD_STATUS, 0),
        (3, 7, outcomes.NO_POST, 1),
        (4, 10, ledger.ID_TAKEN, 2),
        (5, 6, ledger.URL_TAKEN, 1),
        (6, 5, ledger.URL_TAKEN, 1),
        (77, 3, outcomes.UNKNOWN_ITEM, 0),
    ]
    states = streams.item_state(outcomes.patches(spark, out)).filter("field = 'status'")
    assert rows(states, "id", "value") == [(0, "completed"), (1, "completed"), (4, "failed"), (5, "failed"), (6, "failed")]
    # the last batch again, as after a crash before its commit
    for commit in (tmp_path / "checkpoint" / "commits").glob("*2*"):
        commit.unlink()
    stream = spark.readStream.schema(outcomes.OUTCOME).parquet(folder)
    outcomes.run_outcomes(stream, items, start, out, checkpoint)
    assert everything() == (mapped, refused, patches)


def test_bucketed_posts_are_joined_in_place(spark):
    posts = spark.createDataFrame(
        [(i, f"u{i}", f"t{i}", f"content {i}" * 50, [("c", None)], [("x",)]) for i in range(40)],
        "row_id long, url string, title string, content string, categories array<struct<name:string,parent_name:string>>, tags array<struct<name:string>>",
    ).withColumns(
        {
            "blog_url": F.lit("b"),
            "parse_error": F.lit(None).cast("string"),
            "publish_date": F.lit("2024-01-01").cast("timestamp"),
            "publish_date_invalid": F.lit(False),
            "featured_image_url": F.lit(None).cast("string"),
        }
    )
    table = exports.post_table(posts, "inkferry_test_posts", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = spark.createDataFrame([("category", "c", 7), ("tag", "x", 9)], "taxonomy string, name string, id long")
        media = spark.createDataFrame([("u3", 33)], "url string, featured_media long")
        payloads, _ = terms.build_payloads(table, known, featured_media=media)
        assert rows(payloads.filter("url = 'u3'"), "categories", "tags", "featured_media") == [([7], [9], 33)]
        assert payloads.count() == 40
        plan = payloads._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in plan.split("\n") if "Exchange" in line]
        assert shuffled and not any("content" in line for line in shuffled)
        # what a shuffle moves is listed by the node below it
        lines = plan.split("\n")
        for n, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                assert "content" not in lines[n + 1], lines[n + 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE inkferry_test_posts")


def test_overlap_shuffles_no_words(spark):
    rows_of = lambda df: sorted(((r.id, r.n_before, r.n_after, r.n_common, [tuple(w) for w in r.lost]) for r in df.collect()), key=repr)
    schema = "id long, before string, after string"
    texts = [(n, " ".join(f"w{n * i % 37}" for i in range(300)), " ".join(f"w{n * i % 31}" for i in range(280))) for n in range(20)]
    found = overlap.token_overlap(spark.createDataFrame(texts, schema), "id", "before", "after")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for r, (n, before, after) in zip(found.orderBy("id").collect(), texts):
        was, now = collections.Counter(before.split()), collections.Counter(after.split())
        assert (r.id, r.n_before, r.n_after, r.n_common) == (n, 300, 280, sum((was & now).values()))
        assert [tuple(w) for w in r.lost] == sorted((was - now).items())
    # the words of a repeated key count together, in each of its rows; a null key has none
    odd = [(1, "a b", "a"), (1, "b c", "b"), (2, "x", "y"), (None, "p", "q")]
    found = overlap.token_overlap(spark.createDataFrame(odd, schema), "id", "before", "after")
    twice = (1, 4, 2, 2, [("b", 1), ("c", 1)])
    assert rows_of(found) == sorted([twice, twice, (2, 1, 1, 0, [("x", 1)]), (None, 0, 0, 0, [])], key=repr)


def _plain_templates(messages, most_values, least_messages, rounds):
    """Word lists grouped and split one round after the other."""
    groups = collections.defaultdict(list)
    for words in {tuple(m.split()) for m in messages}:
        groups[str(len(words))].append(words)
    for _ in range(rounds):
        grown = collections.defaultdict(list)
        for path, members in groups.items():
            sizes = [(len({m[i] for m in members}), i) for i in range(len(members[0]))]
            able = [(v, i) for v, i in sizes if 1 < v <= most_values and v * least_messages <= len(members)]
            for m in members:
                grown[f"{path}\n{min(able)[1]}={m[min(able)[1]]}" if able else path].append(m)
        groups = grown
    out = {}
    for members in groups.values():
        found = " ".join(ws[0] if len(set(ws)) == 1 else templates.WILDCARD for ws in zip(*members))
        out.update({" ".join(m): found for m in members})
    return out


@pytest.mark.parametrize("most_values, rounds, few", [(20, 8, 10_000), (3, 2, 0), (40, 8, 0), (1, 8, 10_000)])
def test_templates_equal_plain_splitting(spark, monkeypatch, most_values, rounds, few):
    monkeypatch.setattr(templates, "FEW_GROUPS", few)
    values = [2, 5, 25, 45, 400]
    texts = [" ".join(f"w{j}v{(n * (2 * j + 3) + n // 7) % values[(n + j) % 5 if n % 3 else j]}" for j in range(2 + n % 4)) for n in range(700)]
    frame = spark.createDataFrame([(t,) for t in texts], "error_message string")
    found = {r.message: r.template for r in templates.learned_templates(frame, most_values=most_values, rounds=rounds).collect()}
    assert found == _plain_templates(texts, most_values, templates.LEAST_MESSAGES, rounds)


def test_positions_shuffle_few_words(spark):
    """A position with a value per message is not counted word by word."""
    rows_ = [(f"3 {n}", ["post", "failed", f"n{n}"], "3") for n in range(5000)]
    groups = spark.createDataFrame(rows_, "message string, words array<string>, path string")
    found = {r.pos: (r["values"], r.messages, r.word) for r in templates._positions(groups, 20).collect()}
    assert {p: v[:2] for p, v in found.items() if p < 2} == {0: (1, 5000), 1: (1, 5000)}
    assert found[0][2] == "post" and 20 < found[2][0] <= 128 and found[2][2] is None


MAP = "id long, post_url string, dest_post_id long"


def test_clashes_by_address_need_no_components(spark, monkeypatch):
    monkeypatch.setattr(ledger, "components", lambda edges: pytest.fail("rows of one address took part in components"))
    start = spark.createDataFrame([(1, "taken", 1)], MAP)
    new = [(n, f"u{n % 7}", 100 + n) for n in range(10, 60)] + [(70, "taken", 200), (71, "free", 1), (72, None, 3), (73, "x", None)]
    accepted, rejected = ledger.extend_post_map(start, spark.createDataFrame(new, MAP))
    assert rows(accepted, "id") == [(n,) for n in range(10, 17)]
    reasons = collections.Counter(r.reason for r in rejected.collect())
    assert reasons == {ledger.URL_TAKEN: 44, ledger.ID_TAKEN: 1, ledger.URL_NULL: 1, ledger.ID_NULL: 1}


@pytest.mark.parametrize("seed", range(2))
def test_map_rows_clash_as_if_inserted_one_by_one(spark, seed):
    rng = random.Random(seed)
    new = [(n, f"u{rng.randrange(90)}", rng.choice([1000 + n, 1000 + n, 1000 + n, rng.randrange(20)])) for n in range(200)]
    want, urls, ids = [], set(), set()
    for n, url, dest in new:
        reason = ledger.URL_TAKEN if url in urls else ledger.ID_TAKEN if dest in ids else None
        if reason is None:
            urls.add(url)
            ids.add(dest)
        want.append((n, url, dest, reason))
    accepted, rejected = ledger.extend_post_map(spark.createDataFrame([], MAP), spark.createDataFrame(new, MAP))
    columns = ["id", "post_url", "dest_post_id", "reason"]
    found = rows(accepted.withColumn("reason", F.lit(None).cast("string")), *columns) + rows(rejected, *columns)
    assert sorted(found, key=repr) == sorted(want, key=repr)

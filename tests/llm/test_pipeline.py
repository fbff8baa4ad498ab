"""The pipeline's stages on a small table, each against what it promises."""

import random

import corpus_pipeline
from inkferry.llm.common import staged, table
from tests.conftest import SMALL
from tests.llm.conftest import prose


def test_stages_follow_each_other(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = staged(stage(spark, docs, SMALL), name.replace(" ", "-"))
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        seen.append((name, len(before), len(after)))
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
            docs = out
    assert [n for n, _, _ in seen] == [
        "quality classifier",
        "near deduplication",
        "suffix deduplication",
        "benchmark decontamination",
        "packing",
    ]
    assert seen[2][1] == seen[2][2] and seen[4][1] == seen[4][2]
    assert seen[1][2] < seen[1][1]


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "words " * 30, None, None, 180), (2, "", "en", "s", 0)]
    schema = table(spark, SMALL, "documents").schema
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() == 4, name
        empty = stage(spark, docs.limit(0), SMALL)
        assert empty.count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs, SMALL).count() == 4


def test_one_row_of_each_group_of_copies_stays(spark):
    """Copies under one id, without an id, and of both kinds; their text must outlive the suffix stage."""
    rng = random.Random(7)
    again, nameless, mixed, first, second, third = (prose(rng, 150) for _ in range(6))
    texts = [
        (1, again),
        (1, again),
        (None, nameless),
        (None, nameless),
        (3, mixed),
        (None, mixed),
        (2, mixed.upper()),
        (4, first),
        (5, first),
        (5, second),  # a second text under one id is a document of its own
        (6, third),
    ]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts]
    docs = spark.createDataFrame(rows, table(spark, SMALL, "documents").schema).repartition(3)
    out = staged(corpus_pipeline.near_deduplication(spark, docs, SMALL), "one-of-each")
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    one = [(1, again), (2, mixed.upper()), (4, first), (5, second), (6, third), (None, nameless)]
    assert kept == one
    cut = corpus_pipeline.suffix_deduplication(spark, out, SMALL)
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == one


def test_passages_of_over_fifty_words_go(spark):
    """Also those far under 400 bytes; passages of fifty words and documents without repeats stay."""
    rng = random.Random(9)
    short = [" ".join(rng.choice("abcdefgh") + rng.choice("ijklmno") for _ in range(n)) for n in (51, 58, 65)]
    long = [prose(rng, n) for n in (51, 60, 200)]
    fifty = prose(rng, 50)
    assert min(len(p) for p in short) < 160 and all(len(p.split()) > 50 for p in short + long)
    rows, expected = [], []
    for n, passage in enumerate([*short, *long]):
        for copy in range(3):
            before, after = f"{prose(rng, 40)} a{n}b{copy}", f"c{n}d{copy} {prose(rng, 30)}"
            rows.append((10 * n + copy, f"{before} {passage}\n{after}"))
            expected.append((10 * n + copy, f"{before} \n{after}"))
    for i in range(1000, 1010):
        text = f"{prose(rng, 60)} a{i} {fifty} b{i} {prose(rng, 60)}"
        rows.append((i, text))
        expected.append((i, text))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SMALL, "documents").schema)
    cut = corpus_pipeline.suffix_deduplication(spark, docs, SMALL)
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == expected
    assert cut.filter("n_chars <> length(text)").count() == 0

import random

import pytest
from pyspark.sql import types as T

CLASHING = "_row _home _key _text home id set_id label votes posterior size shard slot _bucket key".split()
VOCABULARY = [a + b for a in "ka lo mi nu pe ra so ti".split() for b in "n r s t vel dor".split()]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text) with nulls, empty and long texts, ties, repeats, near copies and shared passages."""
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 90)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "One"),
        (6, base),
        (7, base),
        (8, " ".join(near)),
        (9, base.upper()),
        (9, prose(rng, 40)),  # a second text under one id
        (None, base),
        (10, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 25)),
        (11, prose(rng, 10) + " " + passage + "."),
        (12, passage),
        (13, "éÉß 日本語 " * 60),
        (14, "a" * 900),
        (15, prose(rng, 20000) + " " + passage),
        (16, "\n".join(["the same line again and again here"] * 12)),
        (17, "### $$$ %%% " * 30),
    ]
    rows += [(100 + i, prose(rng, rng.randrange(15, 80))) for i in range(30)]
    rows += [(200 + i, base if i % 2 else f"{base} tail{i}") for i in range(12)]
    return rows


def frame(spark, rows):
    extra = [T.StructField(c, T.StringType()) for c in CLASHING]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *extra])
    return spark.createDataFrame([(*r, *[None, "x"] * len(CLASHING))[: 2 + len(CLASHING)] for r in rows], schema)


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])


def by_row(df, *columns):
    """Sorted tuples, nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

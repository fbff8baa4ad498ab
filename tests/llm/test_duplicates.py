"""Near duplicates, repeated bytes and repeated passages against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from inkferry.llm import minhash, repeats, suffixes
from inkferry.operators.components import components
from tests.llm import plain
from tests.llm.conftest import VOCABULARY, by_row, frame


def expected_groups(rows, size):
    group = plain.groups(rows, size)
    return sorted(
        ((i, len(plain.shingles(t, size)), group.get(i), i is None or group[i] == i) for i, t in rows), key=repr
    )


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(odd_docs, odd_rows, size):
    found = minhash.near_duplicates(odd_docs, shingle_words=size)
    assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == expected_groups(odd_rows, size)


def test_loose_family_is_connected_like_all_pairs(spark):
    """Copies that are linked to some members of a family only, so that bucket centers do not suffice."""
    rng = random.Random(11)
    base = [rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 14)):
            text[at] = f"other{i}x{at}"
        rows.append((i * 7 % 120, " ".join(text)))
    found = minhash.near_duplicates(frame(spark, rows), shingle_words=2)
    assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == expected_groups(rows, 2)


def test_near_duplicates_of_nothing(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_loops(spark):
    chain = [(i, i + 1) for i in range(50)] + [(200, 100), (100, 150), (150, 200), (7, 7), (300, 301)]
    found = dict(components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("length", [5, 40, 400])
def test_repeated_bytes(spark, odd_docs, odd_rows, length, monkeypatch):
    monkeypatch.setattr("inkferry.llm.exchange.HOME_BYTES", 30_000)  # several homes
    done = suffixes.remove_repeats(odd_docs, length=length, keep=["doc_id", "_row", "_home"])
    got = [
        (r.doc_id, r.removal.n_bytes, r.removal.n_removed, len(r.removal.spans), bytes(r.removal.kept))
        for r in done.collect()
    ]
    cut = plain.cut_bytes([t for _, t in odd_rows], length)
    assert sorted(got, key=repr) == sorted(((i, *c) for (i, _), c in zip(odd_rows, cut)), key=repr)


@pytest.mark.parametrize("length", [3, 51])
def test_repeated_words(spark, odd_docs, odd_rows, length, monkeypatch):
    monkeypatch.setattr("inkferry.llm.exchange.HOME_BYTES", 30_000)
    done = suffixes.remove_repeats(odd_docs, length=length, unit="words", as_text=True, keep=["doc_id", "key"])
    got = by_row(done, "doc_id", "removal.kept")
    left = plain.cut_long_repeats([t for _, t in odd_rows], length)
    assert got == sorted(((i, t) for (i, _), t in zip(odd_rows, left)), key=repr)
    sizes = by_row(done, "doc_id", "removal.n_bytes", "removal.n_removed")
    assert sizes == sorted(
        ((i, len((t or "").encode()), len((t or "").encode()) - len(x.encode())) for (i, t), x in zip(odd_rows, left)),
        key=repr,
    )
    with pytest.raises(ValueError):
        suffixes.remove_repeats(odd_docs, unit="lines")


def test_repeated_bytes_as_text(spark, no_docs):
    rows = [(1, "é" * 300 + "x"), (2, "ab" + "é" * 300)]
    done = suffixes.remove_repeats(frame(spark, rows), as_text=True, keep=["doc_id"])
    assert by_row(done, "doc_id", "removal.kept") == [(1, "x"), (2, "ab")]
    assert suffixes.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("q", [2, 3, 13, 17])
def test_difference_cover(q):
    v, cover = suffixes.difference_cover(q)
    assert v == q * q + q + 1 and len(cover) == q + 1
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("window", [4, 13])
def test_passages_seen_before(spark, odd_docs, odd_rows, window, monkeypatch):
    monkeypatch.setattr("inkferry.llm.exchange.HOME_BYTES", 30_000)
    done = repeats.remove_seen_passages(odd_docs, window=window, keep=["doc_id", "_row"])
    cut = plain.cut_words(odd_rows, window)
    got = by_row(done, "doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept")
    assert got == sorted(((i, *c) for (i, _), c in zip(odd_rows, cut)), key=repr)
    lost = done.select(F.expr("aggregate(repeats.spans, 0L, (t, s) -> t + s.word_end - s.word_start)").alias("n"))
    assert lost.agg(F.sum("n")).first()[0] == sum(c[1] for c in cut)


def test_passages_of_nothing(no_docs):
    assert repeats.remove_seen_passages(no_docs).count() == 0


def test_pages_of_one_template_are_not_paired(spark):
    """Pages at a similarity under the threshold meet in buckets; what is joined grows with the rows only."""
    rng = random.Random(13)
    template = [f"t{i}" for i in range(170)]

    def pages(n):
        rows = []
        for i in range(n):
            own = [f"o{i}x{k}" for k in range(30)]
            rows.append((i, " ".join(template[:85] + own + template[85:])))
            if i % 10 == 0:  # a near copy of the page
                own[rng.randrange(30)] = f"new{i}"
                rows.append((100_000 + i, " ".join(template[:85] + own + template[85:])))
        return rows

    tables, sizes = {n: pages(n) for n in (60, 240)}, {}
    for n, rows in tables.items():
        named = frame(spark, rows).select(F.col("doc_id").alias("id"), "text")
        sets = named.mapInArrow(minhash._set_maker(2), "id bigint, set binary").withColumn("label", F.col("id"))
        active = minhash._active(minhash._early_shingles(sets, 80), 80).collect()
        met = {}
        for r in active:
            met.setdefault(r.shingle, set()).add(r.id)
        assert all(any({i, 100_000 + i} <= ids for ids in met.values()) for i in range(0, n, 10))
        sizes[n] = sum(len(ids) ** 2 for ids in met.values())
    assert sizes[240] <= 5 * sizes[60]
    found = minhash.near_duplicates(frame(spark, tables[60]), shingle_words=2)
    assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == expected_groups(tables[60], 2)


def test_maps_never_leave_out_a_link():
    rng = random.Random(14)
    for _ in range(300):
        n = rng.choice([1, 5, 40, 300, 2000])
        one = {rng.getrandbits(64) for _ in range(n)}
        other = set(rng.sample(sorted(one), max(1, len(one) - rng.randrange(1 + len(one) // 6))))
        other |= {rng.getrandbits(64) for _ in range(rng.randrange(1 + len(one) // 8))}
        a, b = (minhash.np.sort(minhash.np.array(sorted(s), minhash.np.uint64)) for s in (one, other))
        maps = [m.tobytes() for m in minhash.set_maps([a, b])]
        batch = minhash.pa.RecordBatch.from_pylist(
            [{"a": 1, "b": 2, "map_a": maps[0], "map_b": maps[1], "size_a": len(a), "size_b": len(b)}]
        )
        kept = next(minhash._near(80)(iter([batch]))).num_rows
        assert kept or not minhash.linked(a, b, 80)

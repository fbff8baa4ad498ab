"""Piece encoding against the library, and periodic runs against a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkferry.llm import periodic, piece_codec
from inkferry.llm.common import vocabulary
from tests.llm import plain
from tests.llm.conftest import by_row, prose

MODEL = vocabulary("piece_bpe_32k.model")
BITS = "a b e t h é 日 本 ß ا ़ 😀 𒀀 � ▁ ▁▁▁▁ <0x0A> <s> 1 23 . A ing".split(" ") + [" ", "  ", "\n", "\t", "\x00", "　"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(spark, odd_docs, odd_rows, no_docs, library):
    coded = piece_codec.encode(odd_docs, MODEL, keep=["doc_id", "home", "key"])
    expected = [(i, library.encode(t or ""), len(library.encode(t or ""))) for i, t in odd_rows]
    assert by_row(coded, "doc_id", "pieces.ids", "pieces.n_tokens") == sorted(expected, key=repr)
    read = piece_codec.decode(coded.select("doc_id", "pieces.ids"), MODEL)
    texts = [(i, library.decode(library.encode(t or ""))) for i, t in odd_rows]
    assert by_row(read, "doc_id", "decoded") == sorted(texts, key=repr)
    assert piece_codec.encode(no_docs, MODEL).count() == 0
    nulls = spark.createDataFrame([(None,), ([],), ([1, 2],)], "ids array<int>")
    assert by_row(piece_codec.decode(nulls, MODEL), "decoded") == [("",), ("",), (None,)]


def test_codec_on_random_strings_and_ids(library):
    rng, model = random.Random(5), piece_codec.load(MODEL)
    codec, decoder = piece_codec.Encoder(model), piece_codec.Decoder(model)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(40)))
        assert list(codec.encode(text)) == library.encode(text), text
        ids = [rng.randrange(300 if rng.random() < 0.7 else 32000) for _ in range(rng.randrange(12))]
        assert decoder.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_long_text_without_a_space(library):
    rng, codec = random.Random(6), piece_codec.Encoder(piece_codec.load(MODEL))
    for text in ("a" * 50_000, "".join(rng.choice("日本語の文字") for _ in range(50_000)), "=-" * 30_000):
        assert list(codec.encode(text)) == library.encode(text)


def test_search_backs_out_of_wrong_pieces():
    """Every string over a small alphabet equals plain merging, so failed places are left for good."""
    merges = "ab bc abc ca cab aa aaa bca cc".split()
    pieces = ["<unk>", *"abc", *merges]
    model = piece_codec.Model(
        tuple(pieces), tuple(-float(i) for i in range(len(pieces))), (2, *[1] * (len(pieces) - 1)), 0, "?", False, False, False
    )
    codec = piece_codec.Encoder(model)
    rng = random.Random(8)
    for _ in range(5000):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        assert [codec.names[i] for i in codec.split(text)] == codec.merged(text), text
    assert list(codec.encode("ddad")) == [0, 1, 0]  # neighbouring unknown characters are one piece


def run_texts():
    rng, out = random.Random(4), []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(0, 6)):
            letters = "abcdef"[: rng.choice([1, 2, 3, 6])]
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, rng.choice([3, 8, 40])))]
            times = rng.choice([1, 2, 4, 5, 9])
            words += (unit * times)[: len(unit) * times - rng.randrange(len(unit))]
        out.append(" ".join(words))
    return out


def test_runs_equal_a_plain_search(spark, odd_rows, no_docs):
    rows = [*odd_rows, *enumerate(run_texts(), 1000), (5000, prose(random.Random(1), 300) + " x y z" * 4000)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, periodic string, start int")
    found = periodic.repeated_runs(docs.repartition(3), keep=["doc_id", "start"])
    got = by_row(found, "doc_id", "periodic.n_words", "periodic.runs", "periodic.kept")
    got = [(i, n, [tuple(r) for r in runs], kept) for i, n, runs, kept in got]
    expected = []
    for i, text in rows:
        words = plain.words(text)
        runs = plain.runs(words)
        gone = {n for s, size, q in runs for n in range(s + q, s + size)}
        expected.append((i, len(words), runs, " ".join(w for n, w in enumerate(words) if n not in gone)))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert periodic.repeated_runs(no_docs).count() == 0


def test_each_text_alone_equals_the_block():
    texts = [t.encode().split() for t in run_texts()]
    together = list(periodic.Texts(texts).judged())
    assert [next(periodic.Texts([t]).judged()) for t in texts] == together


def test_transforms_are_exact():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 4000) * 700_001  # sums of squares near 2**46
    for size in (1, 2, 8, 64):
        starts = np.arange(0, 4000 - 3 * size, size)[:50]
        found = periodic.zero_distances(words, starts, size)
        for row, start in enumerate(starts.tolist()):
            block = words[start : start + size]
            same = [bool((words[start + d : start + d + size] == block).all()) for d in range(size, 2 * size)]
            assert found[row].tolist() == same


def test_equal_hashes_of_unequal_words(monkeypatch):
    """Extension falls back to words when hashes agree everywhere."""
    monkeypatch.setattr(periodic.scan.Hashes, "windows", lambda self, a, b: np.zeros(len(a), np.uint64))
    words = plain.words("p q r " + "a b " * 8 + "s t u v")
    found = next(periodic.Texts([[w.encode() for w in words]]).judged())
    assert [tuple(r.values()) for r in found["runs"]] == plain.runs(words)


def test_longest_run_and_loops(spark):
    docs = spark.createDataFrame(
        [(1, "a a a a a a b c c c c c c"), (2, "x y"), (None, None)], "doc_id long, text string"
    )
    best = periodic.repeated_runs(docs).select("doc_id", periodic.longest_run().alias("r"))
    assert by_row(best, "doc_id", "r.start", "r.length", "r.period") == [
        (1, 0, 6, 1),
        (2, None, None, None),
        (None, None, None, None),
    ]
    import zlib

    rows = [(i, prose(random.Random(i), 30 + i)) for i in range(200)] + [(None, ""), (None, "a b c d e f")]
    changed = periodic.with_loops(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = []
    for i, text in rows:
        h, words = zlib.crc32(b"" if i is None else str(i).encode()), text.split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[k if k < a else a + (k - a) % p] for k in range(n))
        expected.append((i, text))
    assert by_row(changed, "doc_id", "text") == sorted(expected, key=repr)
    assert changed.columns == ["doc_id", "text"]
    assert changed.filter(F.col("doc_id") >= 0).count() == 200

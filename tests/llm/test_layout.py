"""Archives, shards and packing: round trips and invariants."""

import base64
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkferry.llm import packing, sharding, warc
from inkferry.llm.common import vocabulary
from tests.llm.conftest import frame

TOKENIZER = vocabulary("word_bpe_49k.json")

PAGES = [
    (1, "http://a.example/x y\n", "<p>one</p>"),
    (5, "http://b.example", "<p>one</p>"),
    (3, None, "<p>one</p>"),
    (4, "u", None),
    (9, "u", ""),
    (6, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nfake\r\n\r\n"),
    (7, "u", "é日本\r\n\r\n" * 500_000),
    (7, "u", "é日本\r\n\r\n" * 500_000),
    (None, "u", "no id"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(
        [(*p, "x", "y") for p in PAGES], "page_id bigint, url string, html string, archive string, value string"
    )
    warc.write_archives(pages, f"{tmp_path}/streams", least_bytes=least)
    index = warc.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/normal").collect()
    expected = []
    for i, _, html in PAGES:
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        size = len((html or "").encode())
        last = max(same, default=None)
        revisit = size >= least and i is not None and i < last
        expected.append((i, size, digest(html), "revisit" if revisit else "response", last if revisit else None))
    records = warc.read_archives(spark, f"{tmp_path}/normal").collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    payloads = sorted((r.payload or b"").decode() for r in records if r.record_type == "response")
    kept = [h or "" for (_, _, h), e in zip(PAGES, expected) if e[3] == "response"]
    assert payloads == sorted(kept)
    files = {f.parent.name.removeprefix("archive="): f for f in Path(tmp_path).glob("normal/archives/*/part-*")}
    for row in index:
        data = files[row.archive].read_bytes()[row.offset : row.offset + row.length]
        record = warc.read_record(zlib.decompress(data, 31))
        assert (record["page_id"], record["record_type"]) == (row.page_id, row.record_type)
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files.values())
    assert whole.count(b"WARC-Type: ") == len(PAGES)
    fields = ("archive", "number", "offset", "length", "page_id", "record_type", "refers_to", "payload_digest")
    assert {tuple(r[f] for f in fields) for r in records} == {tuple(r[f] for f in fields) for r in index}
    for f in files.values():  # members and nothing else: a strict reader goes from one to the next
        data, at = f.read_bytes(), 0
        while at < len(data):
            stream = zlib.decompressobj(31)
            stream.decompress(data[at:])
            assert stream.eof
            at = len(data) - len(stream.unused_data)


def test_many_rows_of_one_page_take_several_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 64 << 10)
    rows = [(None, "u", "<p>same</p>")] * 3000 + [(1, "u", "<p>other</p>" * 9)] * 1500 + [(2, "u", "<p>other</p>" * 9)] * 3
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    warc.write_archives(pages, f"{tmp_path}/streams")
    index = warc.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/normal")
    sizes = [r["count"] for r in index.groupBy("archive").count().collect()]
    assert sum(sizes) == 4503 and max(sizes) < 700
    found = index.groupBy("page_id", "record_type", "refers_to").count().collect()
    assert {tuple(r) for r in found} == {(None, "response", None, 3000), (1, "revisit", 2, 1500), (2, "response", None, 3)}


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(none).count() == 0


def test_records_over_piece_and_member_bounds():
    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    stream = gzip.compress(one * 3) + b"\0" * 5 + gzip.compress(one * 2)
    assert [r[1] for r in warc.records_of(warc.inflated(stream))] == [b"abc"] * 5
    with pytest.raises(ValueError):
        list(warc.records_of(iter([one, one[:-2]])))


def test_shards_keep_all_rows_and_grow_by_one(odd_docs, odd_rows, no_docs):
    written = sharding.write_shards(odd_docs, 8, bucket_bytes=20_000)
    rows = written.select("doc_id", "text", "size", "text_crc32", "shard", "slot", "grown_shard", "key").collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(odd_rows, key=repr)
    for r in rows:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 8)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.write_shards(no_docs, 8).count() == 0


def test_shards_are_even_and_shuffled(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    rows = sharding.write_shards(docs, 8).select("doc_id", "shard", "slot", "grown_shard").collect()
    again = sharding.write_shards(docs, 8).select("doc_id", "shard", "slot", "grown_shard").collect()
    assert sorted(rows) == sorted(again)
    counts = np.bincount([r.shard for r in rows], minlength=8)
    assert counts.min() > 400 and counts.max() < 600
    assert 330 < sum(r.grown_shard == 8 for r in rows) < 560
    first = [r.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert abs(np.corrcoef(first, range(len(first)))[0, 1]) < 0.2


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_tokens_equal_the_library():
    import pyarrow as pa

    from inkferry.llm import scan
    from inkferry.llm.word_tokens import WordTokenizer, latin_is_stable

    assert latin_is_stable()
    rng = random.Random(2)
    signs = "abcdeABEÉéßÿŒœð×÷'’.,!?-_#12²½ªº \n\t\x85\xa0\x1cİıſ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(300))) for _ in range(400)]
    texts += ["", "<|endoftext|> a", "ΑΣ ǅ é ẖ H̱", "日本語 don't we'll I'm", "a" * 5000]
    texts += [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 40))) for _ in range(300))]
    mine, theirs = WordTokenizer(TOKENIZER), library().encode_batch(texts, add_special_tokens=False)
    found = [ids.tolist() for b in scan.blocks(pa.array(texts), 1000) for ids in mine.block_ids(b)]
    assert found == [t.ids for t in theirs]


def test_packing_keeps_every_id_once(spark, odd_docs, odd_rows, no_docs):
    cut = packing.pieces(odd_docs, TOKENIZER, keep=["doc_id", "key"], window=64, with_ids=True).cache()
    rows = packing.pack(cut, ["doc_id", "start", "ids_crc32"], window=64).collect()
    tokens = library()
    expected = [
        (i, [*tokens.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in odd_rows
    ]
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in expected)
    wanted = sorted(
        ((i, n, len(ids[n : n + 64]), zlib.crc32(np.array(ids[n : n + 64], "<u4").tobytes()), len(ids))
         for i, ids in expected for n in range(0, len(ids), 64)), key=repr
    )
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=repr) == wanted
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64
    assert sum(64 - n for n in filled.values()) <= 0.03 * sum(filled.values())
    assert packing.packed(no_docs, TOKENIZER).count() == 0


def test_plan_fills_closest():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 8))}
        room = rng.randrange(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums |= {s + length * k for s in sums for k in range(n + 1)}
        fill = packing.best_fill(list(counts), list(counts.values()), room)
        assert sum(length * n for length, n in fill) == max(s for s in sums if s <= room)
        assert all(n <= counts[length] for length, n in fill)
        patterns = packing.plan(counts, 60)
        used = {}
        for times, pattern in patterns:
            assert sum(length * n for length, n in pattern) <= 60
            for length, n in pattern:
                used[length] = used.get(length, 0) + times * n
        assert used == counts


def test_ranks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    cut = spark.createDataFrame([(i, 0, 10 + i % 3) for i in range(60)], "doc_id bigint, start bigint, length bigint")
    rows = packing.pack(cut, ["doc_id", "start"], window=32).collect()
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert len({(s, o) for s, o, _ in taken}) == 60
    for (s, o, n), (t, p, _) in zip(taken, taken[1:]):
        assert t > s and p == 0 or t == s and p == o + n
    assert frame(spark, []).count() == 0


def plain_hash(*values):
    """xxHash of numbers one after another, each hash the seed of the next; a null leaves it as it is."""
    import struct

    import xxhash

    found = 42
    for form, value in values:
        if value is not None:
            found = xxhash.xxh64_intdigest(struct.pack(form, value), found)
    return found - (1 << 64) if found >= 1 << 63 else found


def test_shard_is_the_greatest_hash(spark):
    keys = [None, 0, 1, -5, *random.Random(6).sample(range(1 << 40), 300)]
    docs = spark.createDataFrame([(k, "x") for k in keys], "doc_id bigint, text string")

    def plain_shard(key, n):
        hashes = [plain_hash(("<q", key), ("<i", sharding.SEED), ("<i", i)) for i in range(n)]
        return hashes.index(max(hashes))

    rows = sharding.write_shards(docs, 8).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {k: (plain_shard(k, 8), plain_shard(k, 9)) for k in keys}

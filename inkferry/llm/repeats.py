"""Removal of word passages that a document with a smaller id has already, by winnowed look-up.

Seeds are winnowed: of all word k-grams in a window, the one with the least hash. Equal windows have the
same seed, so windows whose seed is in one document only are left out. Nothing is extended from a seed:
each window left is looked up whole, in a second exchange of hashes, and maximal runs of windows that a
smaller document has too are the repeats. Seeds and windows are joined through homes (see `exchange`):
what travels is a hash with the smallest and largest document that has it, so a passage that a third of
all documents share costs a row per home and never a pair per two documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm import exchange, scan
from inkferry.llm.common import partitions_for, ready, staged, text_bytes

WINDOW = 13
LAST = np.iinfo(np.int64).max
REPEATS = (
    "struct<n_words:bigint,n_removed:bigint,"
    "spans:array<struct<word_start:bigint,word_end:bigint>>,kept:string>"
)


class Windows:
    """Windows of a home's texts and the seed of each."""

    def __init__(self, block: scan.Block, ids: np.ndarray, window: int):
        self.words = scan.words(block, scan.is_space())
        self.hashes = scan.Hashes(scan.word_hashes(block, self.words))
        size = np.diff(self.words.bounds)
        left = np.repeat(self.words.bounds[1:], size) - np.arange(len(self.words.starts))
        self.window = window
        self.starts = np.flatnonzero(left >= window)
        self.docs = ids[self.words.text[self.starts]]
        seed_words = (window + 2) // 3
        grams = self.hashes.windows(
            np.arange(max(0, len(left) - seed_words + 1)),
            np.arange(seed_words, len(left) + 1) if len(left) >= seed_words else np.zeros(0, np.int64),
        )
        self.seeds = np.zeros(0, np.uint64)
        if len(self.starts):
            around = np.lib.stride_tricks.sliding_window_view(grams, window - seed_words + 1)
            self.seeds = least(around, self.starts)

    def all(self, chosen: np.ndarray) -> np.ndarray:
        starts = self.starts[chosen]
        return self.hashes.windows(starts, starts + self.window)


def least(around: np.ndarray, rows: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    parts = [around[rows[i : i + step]].min(axis=1) for i in range(0, len(rows), step)]
    return np.concatenate(parts)


class Known:
    """Distinct hashes with the smallest and largest document that has each."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray):
        self.hashes, self.place, _ = exchange.distinct(hashes)
        self.smallest = np.full(len(self.hashes), LAST)
        self.largest = np.full(len(self.hashes), -LAST - 1)
        np.minimum.at(self.smallest, self.place, docs)
        np.maximum.at(self.largest, self.place, docs)

    def send(self, home: int, n: int) -> pa.Table:
        return exchange.send(home, self.hashes, n, self.smallest, self.largest)

    def first(self, answers: pa.Table, number: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each given hash: whether several documents have it, and the smallest that does."""
        hits, values = exchange.heard(answers, number, self.hashes, n, numbers=True)
        smallest = np.where(hits, np.minimum(values, self.smallest), self.smallest)
        several = hits | (self.smallest < self.largest)
        return several[self.place], smallest[self.place]


def resolve(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits are hashes that several documents have; the answer is the smallest of them."""
    order = np.argsort(hashes)
    h = hashes[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(first)
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    smallest = np.minimum.reduceat(a[order], begin)
    largest = np.maximum.reduceat(b[order], begin)
    size = np.diff(np.append(begin, len(h)))
    hits, answers = np.empty(len(h), bool), np.empty(len(h), np.int64)
    hits[order] = np.repeat(smallest < largest, size)
    answers[order] = np.repeat(smallest, size)
    return hits, answers


def remove_seen_passages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    out: str = "repeats",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add a struct (n_words, n_removed, spans, kept): the words without passages seen before.

    A word goes if it lies in a window of `window` consecutive words whose sequence also starts in a row
    with a smaller key; windows are judged on the input. `spans` are the maximal removed runs in words,
    `kept` the other words joined by one space. `key` is an integer.

    Null and empty texts have no words; texts under a window stay whole. Rows that share a key are one
    document and remove nothing from each other. A null key counts as larger than any. A column already
    named `out` is replaced; an empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = ready(docs.sparkSession)
    columns = [c for c in (keep if keep is not None else docs.columns) if c != out]
    own = [f"c{i}" for i in range(len(columns))]  # no clash with the columns of the layout
    n_bytes = text_bytes(docs, text)
    source = docs.select(
        *[F.col(c).alias(n) for c, n in zip(columns, own)],
        F.coalesce(F.col(key).cast("bigint"), F.lit(int(LAST))).alias("_key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"),
    )
    homes, _ = exchange.housed(source, "_text", n_bytes, "passages")
    n = partitions_for(spark, n_bytes // 20, exchange.BUCKET_HASHES)
    texts = homes.select("_home", "_row", "_key", "_text")

    def opened(table: pa.Table) -> tuple[pa.Table, scan.Block, Windows, int]:
        table, block = exchange.home_block(table, "_text")
        found = Windows(block, table.column("_key").to_numpy(), window)
        return table, block, found, table.column("_home")[0].as_py()

    def send_seeds(table: pa.Table) -> pa.Table:
        _, _, found, home = opened(table)
        return Known(found.seeds, found.docs).send(home, n)

    first = staged(
        exchange.answer(exchange.per_home(texts, send_seeds, exchange.SENT), resolve, 1), "seeds"
    )

    def joined(found: Windows, answers: pa.Table) -> np.ndarray:
        several, _ = Known(found.seeds, found.docs).first(answers, 1, n)
        return np.flatnonzero(several)

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return exchange.send(0, np.zeros(0, np.uint64), n)
        _, _, found, home = opened(table)
        chosen = joined(found, answers)
        return Known(found.all(chosen), found.docs[chosen]).send(home, n)

    second = staged(
        exchange.answer(exchange.with_answers(texts, first, send_windows, exchange.SENT), resolve, 2),
        "windows",
    )
    schema = T.StructType(
        [
            *[T.StructField(o, docs.schema[c].dataType) for c, o in zip(columns, own)],
            T.StructField(out, T._parse_datatype_string(REPEATS)),
        ]
    )
    nothing = to_arrow_schema(schema)
    span = pa.list_(pa.struct([("word_start", pa.int64()), ("word_end", pa.int64())]))
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string())]
    )

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return nothing.empty_table()
        table, block, found, _ = opened(table)
        chosen = joined(found, answers)
        _, smallest = Known(found.all(chosen), found.docs[chosen]).first(answers, 2, n)
        repeated = found.starts[chosen[smallest < found.docs[chosen]]]
        words = found.words
        change = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        rows, data = [], block.data.tobytes()
        for low, high in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            flags = gone[low:high]
            edges = np.flatnonzero(np.diff(flags, prepend=False, append=False)).reshape(-1, 2)
            rest = np.flatnonzero(~flags) + low
            kept = [data[a:b] for a, b in zip(words.starts[rest].tolist(), words.ends[rest].tolist())]
            rows.append(
                {
                    "n_words": high - low,
                    "n_removed": high - low - len(rest),
                    "spans": [{"word_start": a, "word_end": b} for a, b in edges.tolist()],
                    "kept": b" ".join(kept).decode(),
                }
            )
        return table.select(own).append_column(out, pa.array(rows, kind))

    done = exchange.with_answers(homes, first.unionByName(second), cut, schema)
    return done.select(*[F.col(o).alias(c) for c, o in zip(columns, own)], out)

"""Asking, for very many hashes, where else each occurs, without a row per hash.

Texts are laid out once in homes of a few megabytes, in a table bucketed by home. A home sends its
distinct hashes, sorted and packed, to the buckets of the hash space; a bucket sorts what it got and
answers each home by a bit per hash and a number per hit. A hash that a third of all texts share is
still sent once per home. Homes and buckets grow in number with the input, not in size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkferry.llm import scan
from inkferry.llm.common import bucketed, partitions_for

HOME_BYTES = 2 << 20
TABLE_BYTES = 32 << 20  # of texts in one bucket of the table
BUCKET_HASHES = 2_000_000

SENT = "bucket bigint, home bigint, hashes binary, a binary, b binary"
ANSWERED = "home bigint, round int, bucket bigint, hits binary, answers binary"
_SENT = pa.schema(
    [("bucket", pa.int64()), ("home", pa.int64())] + [(n, pa.binary()) for n in ("hashes", "a", "b")]
)
_ANSWERED = pa.schema(
    [("home", pa.int64()), ("round", pa.int32()), ("bucket", pa.int64())]
    + [(n, pa.binary()) for n in ("hits", "answers")]
)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses where neighbours are alike."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def housed(docs: DataFrame, text: str, n_bytes: int, name: str) -> tuple[DataFrame, int]:
    """The table of homes: the rows with a number `_row` and their `_home`; and how many homes."""
    n_homes = max(1, -(-n_bytes // HOME_BYTES))
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    placed = numbered.withColumn("_home", F.pmod(F.xxhash64("_row"), F.lit(n_homes)))
    n = partitions_for(docs.sparkSession, n_bytes, TABLE_BYTES)
    return bucketed(placed, "_home", n, name), n_homes


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def send(home: int, hashes: np.ndarray, n: int, a: np.ndarray | None = None, b: np.ndarray | None = None):
    """Rows of one home: its sorted hashes with up to two numbers each, a slice per bucket."""
    buckets = bucket_of(hashes, n)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts = [0, *cuts.tolist()] if len(hashes) else []
    rows = []
    for low, high in zip(starts, [*starts[1:], len(hashes)]):
        part = slice(low, high)
        rows.append(
            {
                "bucket": int(buckets[low]),
                "home": home,
                "hashes": planes(hashes[part]),
                "a": planes(a[part]) if a is not None else b"",
                "b": planes(b[part]) if b is not None else b"",
            }
        )
    return pa.Table.from_pylist(rows, _SENT)


def answer(
    sent: DataFrame, resolve: Callable[..., tuple[np.ndarray, np.ndarray | None]], number: int
) -> DataFrame:
    """Answers of every bucket; `resolve(hashes, a, b)` gives hit flags and numbers for all its hashes."""

    def run(table: pa.Table) -> pa.Table:
        parts = [[unplanes(x, np.uint64) for x in table.column("hashes").to_pylist()]]
        for name in ("a", "b"):
            parts.append([unplanes(x, np.int64) for x in table.column(name).to_pylist()])
        hashes, a, b = (np.concatenate(x) for x in parts)
        hits, answers = resolve(hashes, a, b)
        rows, at = [], 0
        places = zip(table.column("home").to_pylist(), table.column("bucket").to_pylist(), parts[0])
        for home, bucket, own in places:
            part = slice(at, at + len(own))
            at += len(own)
            if hits[part].any():
                numbers = planes(answers[part][hits[part]]) if answers is not None else b""
                bits = np.packbits(hits[part]).tobytes()
                rows.append(
                    {"home": home, "round": number, "bucket": bucket, "hits": bits, "answers": numbers}
                )
        return pa.Table.from_pylist(rows, _ANSWERED)

    return sent.groupBy("bucket").applyInArrow(run, ANSWERED)


def heard(
    table: pa.Table, number: int, hashes: np.ndarray, n: int, numbers: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """A home's answers in the order of the hashes it sent: hit flags, and a number per hit (else 0)."""
    hits = np.zeros(len(hashes), bool)
    values = np.zeros(len(hashes) if numbers else 0, np.int64)
    buckets = bucket_of(hashes, n)
    for row in table.to_pylist():
        if row["round"] != number:
            continue
        low, high = np.searchsorted(buckets, [row["bucket"], row["bucket"] + 1])
        hits[low:high] = np.unpackbits(np.frombuffer(row["hits"], np.uint8), count=high - low)
        if numbers:
            values[low:high][hits[low:high]] = unplanes(row["answers"], np.int64)
    return hits, values


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the place of each given hash among them, and how often each occurs."""
    return np.unique(hashes, return_inverse=True, return_counts=True)


def home_block(table: pa.Table, text: str) -> tuple[pa.Table, scan.Block]:
    """The home's rows in their fixed order, and their texts as one block."""
    table = table.sort_by("_row")
    return table, next(scan.blocks(table.column(text), 1 << 60))


def per_home(table: DataFrame, run: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    return table.groupBy("_home").applyInArrow(run, schema)


def with_answers(
    table: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema
) -> DataFrame:
    """Bring answers home; the texts stay where they are."""
    named = answers.withColumnRenamed("home", "_home")
    return table.groupBy("_home").cogroup(named.groupBy("_home")).applyInArrow(run, schema)



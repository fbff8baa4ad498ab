"""Packing documents into training sequences by minimum bin slack.

Documents are cut into pieces of at most a window; which pieces share a window is decided on the
histogram of lengths alone, which has at most one row per length whatever the corpus.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm import scan
from inkferry.llm.common import ready, staged

WINDOW = 4096
END_ID = 2
RANK_ROWS = 500_000  # rows numbered by one task
TOKEN_BLOCK = 4 << 20

_tokenizers: dict[str, object] = {}  # of this worker, by path
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cutter(
    path: str, text: str, keep: list[str], window: int, end_id: int, with_ids: bool, schema: pa.Schema
) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from inkferry.llm.word_tokens import WordTokenizer

        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        tokenizer = _tokenizers[path]
        for batch in batches:
            for block in scan.blocks(batch.column(text), TOKEN_BLOCK):
                rows, start, length, crc, total, values = [], [], [], [], [], []
                for row, ids in enumerate(tokenizer.block_ids(block), block.first):
                    whole = np.append(ids.astype("<u4"), np.uint32(end_id))
                    for at in range(0, len(whole), window):
                        piece = whole[at : at + window]
                        rows.append(row)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(whole))
                        if with_ids:
                            values.append(piece)
                kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
                made = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                made += [pa.array(values, pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=schema)

    return run


def pieces(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Token ids of every whole text, with `end_id` behind them, cut after every `window` ids.

    One row per piece: the `keep` columns (default: all but the text), start, length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers), doc_tokens and, if asked for, the ids. A null or
    empty text is the end id alone; repeated rows are cut one by one. Input columns with the name of a
    piece's column are dropped.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ready(docs.sparkSession)
    made = T._parse_datatype_string(PIECE + (", ids array<bigint>" if with_ids else ""))
    columns = keep if keep is not None else [c for c in docs.columns if c != text]
    columns = [c for c in columns if c not in made.names]
    schema = T.StructType([*[docs.schema[c] for c in columns], *made.fields])
    run = _cutter(tokenizer, text, columns, window, end_id, with_ids, to_arrow_schema(schema))
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def best_fill(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of a multiset whose sum is the closest to `room` from below.

    Sums are bits of one integer; each length shifts in as many copies as there are. The copies used
    are read back from the bits before each length.
    """
    if room <= 0:
        return []
    mask, reached, before = (1 << (room + 1)) - 1, 1, []
    for length, count in zip(lengths, counts):
        if length > room or not count:
            continue
        before.append((length, count, reached))
        left, step = min(count, room // length), 1
        while left:
            take = min(step, left)
            reached |= (reached << (take * length)) & mask
            left -= take
            step *= 2
        if reached >> room & 1:
            break
    target, used = reached.bit_length() - 1, []
    for length, count, reached in reversed(before):
        n = 0
        while not reached >> (target - n * length) & 1:
            n += 1
        if n:
            used.append((length, n))
            target -= n * length
    return used


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, pieces of it in each)]) that use up the histogram.

    The longest piece left opens a window and the best fill closes it; the pattern is used as often as
    its rarest length allows, so each pattern uses up a length or all but a few of its pieces.
    """
    counts = {length: n for length, n in sorted(histogram.items(), reverse=True) if n > 0}
    patterns = []
    while counts:
        longest = next(iter(counts))
        counts[longest] -= 1
        fill = dict(best_fill(list(counts), list(counts.values()), window - longest))
        counts[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in fill.items())
        patterns.append((times, sorted(fill.items(), reverse=True)))
        for length, n in fill.items():
            counts[length] -= times * n
            if not counts[length]:
                del counts[length]
    return patterns


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, pieces in each sequence, first sequence, offset), by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, fill in patterns:
        offset = 0
        for length, n in fill:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placer(places: np.ndarray, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] * (1 << 44) + places[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            _, first, n, sequence, offset = places[at].T
            turn, place = np.divmod(rank - first, n)
            columns = [batch.column(c) for c in schema.names[:-2]]
            columns += [pa.array(sequence + turn), pa.array(offset + place * length)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def pack(cut: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """Give each piece a sequence_id and its offset there; sequences are filled without gaps from 0.

    `cut` has one row per piece with its `length` (1 to `window`) and is best read from a table, since
    it is counted, then numbered. `keys` order the pieces of one length. Rows that are equal in all
    keys may swap places. An empty table packs to an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    cut = cut.drop("sequence_id", "offset", "_rank", "_block")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan(histogram, window))
    n_blocks = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    blocked = cut.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(n_blocks)))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy("length", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    within = Window.partitionBy("length", "_block").orderBy(*keys)
    ranked = (
        blocked.withColumn("_place", F.row_number().over(within))
        .join(shifts, ["length", "_block"])
        .withColumn("_rank", F.col("_place") + F.col("_shift") - 1)
        .select(*cut.columns, "_rank")
    )
    schema = T.StructType([*cut.schema.fields]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_placer(places, to_arrow_schema(schema)), schema)


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut and pack a table of documents; the pieces are staged, as they are read three times."""
    cut = staged(pieces(docs, tokenizer, text, [key]), f"pieces-{uuid.uuid4().hex[:8]}")
    return pack(cut, [key, "start", "ids_crc32"])

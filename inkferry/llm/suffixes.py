"""Removal of repeated strings of bytes or words by difference-cover, blockwise sorting of suffixes.

A difference cover modulo v is a set of residues such that any two positions have a common shift under
v at which both are cover positions. So two equal strings of `length` bytes share a pair of cover
positions followed by at least length - v + 1 equal bytes. Cover suffixes are sorted first, one bucket of
the hash space at a time, which ranks them into classes of equal beginnings; a suffix whose cover
positions are all unique cannot repeat and is never sorted. A class whose members agree on all bytes
that any string through them can have, v - 1 before and `length` from there, settles by rank alone all
suffixes that start under v before its members: the inside of long ties, where nearly all repeated
bytes lie, is never compared. The suffixes before members of a mixed class, at the ends of ties, are
sorted by their first `length` bytes in the same way, bucket by bucket. Beginnings are compared by
64-bit hashes, so equal ones fall together but classes are in hash order: repeats need equality only.
The same holds with words in the place of bytes; a suffix then starts at a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm import exchange, scan
from inkferry.llm.common import partitions_for, ready, staged, text_bytes

LENGTH = 400
MIXED, SETTLED = 1, 2  # classes of cover positions
SEGMENT = 1 << 20  # symbols whose hashes are in memory at once


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def difference_cover(q: int) -> tuple[int, list[int]]:
    """A Singer difference set: v = q * q + q + 1 for a prime q, with q + 1 residues.

    The powers of x modulo a cubic over the integers mod q run through the points of a plane; those
    without a square term are a line, and any two points have one difference on it.
    """
    v = q * q + q + 1
    for c2, c1, c0 in np.ndindex(q, q, q):
        point, line = (1, 0, 0), []
        for i in range(v):
            if point[2] == 0:
                line.append(i)
            a0, a1, a2 = point
            point = ((-a2 * c0) % q, (a0 - a2 * c1) % q, (a1 - a2 * c2) % q)
        if len(line) == q + 1 and len({(a - b) % v for a in line for b in line}) == v:
            return v, line
    raise ValueError(f"no difference set for {q}")


def cover_for(length: int) -> tuple[int, list[int]]:
    """The largest cover whose period is at most four fifths of the length."""
    fitting = [q for q in range(2, 200) if is_prime(q) and 5 * (q * q + q + 1) <= 4 * length]
    return difference_cover(max(fitting)) if fitting else (1, [0])


class Symbols:
    """The bytes, or the words, of a home's texts, laid end to end."""

    def __init__(self, block: scan.Block, unit: str = "bytes"):
        self.block, self.words = block, None
        if unit == "words":
            self.words = scan.words(block, scan.is_space())
            self.values, self.starts = scan.word_hashes(block, self.words), self.words.bounds
        else:
            self.values, self.starts = block.data, block.starts

    def __len__(self) -> int:
        return len(self.values)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the windows, whose starts rise, with a segment of the symbols in memory at a time."""
        table = scan.byte_values() if self.words is None else None
        out = np.empty(len(starts), np.uint64)
        for low in range(0, len(self), SEGMENT):
            first, last = np.searchsorted(starts, [low, low + SEGMENT])
            if first < last:
                high = int(ends[first:last].max())
                values = self.values[low:high]
                hashes = scan.Hashes(values if table is None else table[values])
                out[first:last] = hashes.windows(starts[first:last] - low, ends[first:last] - low)
        return out

    def in_bytes(self, flags: np.ndarray) -> np.ndarray:
        """Flags of the bytes that flagged symbols take up, with what is between neighbouring words."""
        if self.words is None:
            return flags
        edge = np.zeros(len(flags) + 1, bool)
        edge[self.starts] = True
        begins, ends = flags.copy(), flags.copy()
        begins[1:] &= ~flags[:-1] | edge[1:-1]
        ends[:-1] &= ~flags[1:] | edge[1:-1]
        change = np.zeros(len(self.block.data) + 1, np.int32)
        change[self.words.starts[begins]] += 1
        change[self.words.ends[ends]] -= 1
        return np.cumsum(change[:-1]) > 0


class Cover:
    """Cover positions of a home's texts with the hashes of their beginnings."""

    def __init__(self, symbols: Symbols, length: int, v: int, residues: list[int]):
        self.symbols, self.length, self.v = symbols, length, v
        flags = np.zeros(v, bool)
        flags[residues] = True
        size = np.diff(symbols.starts)
        at = np.arange(len(symbols)) - np.repeat(symbols.starts[:-1], size)
        self.left = np.repeat(size, size) - at  # symbols to the end of the text
        self.positions = np.flatnonzero(flags[at % v] & (self.left >= length - v + 1))
        starts, left = self.positions, self.left[self.positions]
        self.hashes = symbols.hashes(starts, starts + (length - v + 1))
        self.first = np.maximum(starts - v + 1, self.text_start(starts))
        context = symbols.hashes(self.first, starts + np.minimum(left, length))
        context = scan.mixed(context ^ scan.mixed((starts - self.first).astype(np.uint64)))
        # 48 bits of each travel: a false tie of classes only means more starts to compare, and contexts
        # are compared inside a class
        self.hashes &= ~np.uint64(0xFFFF)
        context &= np.uint64((1 << 48) - 1)
        order = np.lexsort((context, self.hashes))
        h, x = self.hashes[order], context[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
        self.place = np.empty(len(h), np.int64)  # of each cover position among the distinct pairs
        self.place[order] = np.cumsum(new) - 1
        self.sent, self.sent_context = h[new], x[new]
        self.copies = np.bincount(self.place, minlength=int(new.sum()))

    def starts(self, table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Flags of starts that repeat for certain, and the starts that have to be compared."""
        tied, codes = exchange.heard(table, 1, self.sent, n, numbers=True)
        settled = ((codes == SETTLED) | (~tied & (self.copies > 1)))[self.place]
        mixed = (codes == MIXED)[self.place]
        whole = self.left >= self.length
        certain = self.before(settled) & whole
        return certain, np.flatnonzero(self.before(mixed) & whole)

    def before(self, flags: np.ndarray) -> np.ndarray:
        """Flags of the starts under v before the chosen cover positions, or at them."""
        first = self.first[flags]
        return covered(first, self.positions[flags] + 1 - first, len(self.symbols))

    def text_start(self, positions: np.ndarray) -> np.ndarray:
        starts = self.symbols.starts
        return starts[np.searchsorted(starts, positions, "right") - 1]


def covered(starts: np.ndarray, length: int | np.ndarray, size: int) -> np.ndarray:
    """Flags of the symbols covered by stretches of `length` from `starts`."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, size), -1)
    return np.cumsum(change[:-1]) > 0


def resolve_cover(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tied classes: SETTLED if all members have the same context, else MIXED."""
    order = np.lexsort((a, hashes))
    h, x = hashes[order], a[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(h)))
    same = x[begin] == x[begin + size - 1] if len(h) else np.zeros(0, bool)
    code = np.where(size < 2, 0, np.where(same, SETTLED, MIXED))
    codes = np.empty(len(h), np.int64)
    codes[order] = np.repeat(code, size)
    return codes > 0, codes


def occurs_again(hashes: np.ndarray) -> np.ndarray:
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = np.zeros(len(hashes), bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.empty(len(hashes), bool)
    out[order] = same
    return out


def resolve_starts(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, None]:
    return occurs_again(hashes), None


REMOVED = "struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<start:bigint,stop:bigint>>,kept:{}>"


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    length: int = LENGTH,
    out: str = "removal",
    keep: list[str] | None = None,
    as_text: bool = False,
    unit: str = "bytes",
) -> DataFrame:
    """Add a struct (n_bytes, n_removed, spans, kept): the text without its repeated bytes.

    A byte of the UTF-8 text goes if it lies in a string of `length` bytes that starts at another place
    too, in the same or another row; all copies go, and strings are judged on the input. With the unit
    `words` strings are `length` words, whatever white space is between them, and what is between two
    removed words goes too. `spans` are the maximal removed runs in bytes, `kept` the rest joined, as
    bytes, since a cut may split a character; with `as_text` it is a string, without the characters that
    a cut has split.

    Null and empty texts have no bytes. Repeated rows are copies of each other, so all their bytes go
    from `length` bytes (or words) on. Shorter texts stay whole. A column already named `out` is replaced; an empty
    table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = ready(docs.sparkSession)
    columns = [c for c in (keep if keep is not None else docs.columns) if c != out]
    if unit not in ("bytes", "words"):
        raise ValueError(f"no unit {unit!r}")
    v, residues = cover_for(length)
    n_bytes = text_bytes(docs, text)
    own = [f"c{i}" for i in range(len(columns))]  # no clash with the columns of the layout
    source = docs.select(
        *[F.col(c).alias(n) for c, n in zip(columns, own)],
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"),
    )
    homes, _ = exchange.housed(source, "_text", n_bytes, "texts")
    n = partitions_for(spark, n_bytes * len(residues) // v, exchange.BUCKET_HASHES)
    texts = homes.select("_home", "_row", "_text")

    def send_cover(table: pa.Table) -> pa.Table:
        table, block = exchange.home_block(table, "_text")
        cover = Cover(Symbols(block, unit), length, v, residues)
        home = table.column("_home")[0].as_py()
        return exchange.send(home, cover.sent, n, cover.sent_context.view(np.int64))

    first = staged(
        exchange.answer(exchange.per_home(texts, send_cover, exchange.SENT), resolve_cover, 1), "cover"
    )

    def send_starts(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return exchange.send(0, np.zeros(0, np.uint64), n)
        table, block = exchange.home_block(table, "_text")
        symbols = Symbols(block, unit)
        _, open_starts = Cover(symbols, length, v, residues).starts(answers, n)
        hashes = np.unique(symbols.hashes(open_starts, open_starts + length))
        return exchange.send(table.column("_home")[0].as_py(), hashes, n)

    second = staged(
        exchange.answer(
            exchange.with_answers(texts, first, send_starts, exchange.SENT), resolve_starts, 2
        ),
        "starts",
    )
    schema = T.StructType(
        [
            *[T.StructField(o, docs.schema[c].dataType) for c, o in zip(columns, own)],
            T.StructField(out, T._parse_datatype_string(REMOVED.format("string" if as_text else "binary"))),
        ]
    )

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, block = exchange.home_block(table, "_text")
        symbols = Symbols(block, unit)
        repeats, open_starts = Cover(symbols, length, v, residues).starts(answers, n)
        hashes, place, copies = exchange.distinct(symbols.hashes(open_starts, open_starts + length))
        tied, _ = exchange.heard(answers, 2, hashes, n)
        repeats[open_starts[(tied | (copies > 1))[place]]] = True
        gone = symbols.in_bytes(covered(np.flatnonzero(repeats), length, len(symbols)))
        rows = []
        for low, high in zip(block.starts[:-1].tolist(), block.starts[1:].tolist()):
            flags = gone[low:high]
            rest = block.data[low:high][~flags].tobytes()
            edges = np.flatnonzero(np.diff(flags, prepend=False, append=False)).reshape(-1, 2)
            rows.append(
                {
                    "n_bytes": high - low,
                    "n_removed": int(flags.sum()),
                    "spans": [{"start": a, "stop": b} for a, b in edges.tolist()],
                    "kept": rest.decode(errors="ignore") if as_text else rest,
                }
            )
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kind = pa.struct(
            [
                ("n_bytes", pa.int64()),
                ("n_removed", pa.int64()),
                ("spans", span),
                ("kept", pa.string() if as_text else pa.binary()),
            ]
        )
        return table.select(own).append_column(out, pa.array(rows, kind))

    def cut_or_nothing(table: pa.Table, answers: pa.Table) -> pa.Table:
        return cut(table, answers) if len(table) else nothing.empty_table()

    nothing = to_arrow_schema(schema)
    answers = first.unionByName(second)
    done = exchange.with_answers(homes, answers, cut_or_nothing, schema)
    return done.select(*[F.col(o).alias(c) for c, o in zip(columns, own)], out)


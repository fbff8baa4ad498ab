"""Benchmark decontamination: which words of a document repeat a benchmark item.

An Aho-Corasick automaton over the word sequences of the normalised items scans every text once; hits
are mapped back to offsets in the original text. The windows of all items lie in files of sorted window
hashes and words, which every executor gets and maps into memory, so they take page cache, not heap,
and are shared by its workers. For a block of texts the automaton holds those windows whose hash occurs
in the block, word for word; all others cannot match. So texts are read once, however long the
benchmark, and nothing is shuffled.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.feather as feather
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm import scan
from inkferry.llm.common import ready

WINDOW = 13
PIECE_WORDS = 1000  # long items are cut into overlapping pieces of this many windows
PART_BYTES = 8 << 20  # of item text in one part of the window files; the driver holds one at a time
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SPAN = "struct<word_start:bigint,word_end:bigint,char_start:bigint,char_end:bigint>"
RESULT = f"struct<n_words:bigint,n_hit:bigint,spans:array<{SPAN}>,items:array<string>>"


class Automaton:
    """Windows of items as sequences of word numbers; words of no window have no number."""

    def __init__(self, owners: dict[tuple[bytes, ...], set[str]]):
        import ahocorasick

        vocabulary = sorted({w for window in owners for w in window})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.shortest = min(map(len, owners), default=0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in owners.items():
            self.machine.add_word(tuple(number[w] for w in window), (len(window), sorted(items)))
        self.machine.make_automaton()
        self.number = number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Word numbers, -1 for words of no window."""
        return np.array([self.number.get(w, -1) for w in words], np.int64)


@dataclass
class Part:
    """Distinct windows of some items: sorted hashes, the place and size of their words, their items."""

    hashes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    owners: pa.ListArray
    words: pa.Array
    items: pa.Array

    def windows(self, hashes: np.ndarray) -> np.ndarray:
        """The windows with one of the given distinct hashes."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at[self.hashes[at] == hashes]

    def sequence(self, window: int) -> tuple[bytes, ...]:
        return tuple(self.words.slice(int(self.first[window]), int(self.size[window])).to_pylist())

    def names(self, window: int) -> list[str]:
        return self.items.take(self.owners[int(window)].values).to_pylist()


def write_part(rows: list, folder: str, token: str, number: int) -> tuple[list[str], set[int]]:
    """Files of the windows of some pieces (item, words); and the sizes of the windows.

    Windows are told apart by 64-bit hashes here. Of two that shared one by accident only the first would
    be kept: for 10 million windows in a part that has a chance of 3 in a million.
    """
    words = [w.encode() for _, found in rows for w in found]
    lengths = np.array([len(found) for _, found in rows], np.int64)
    block = next(scan.blocks(pa.array([b" ".join(words)], pa.binary()), 1 << 60))
    found = scan.words(block, scan.not_alphanumeric())
    hashes = scan.Hashes(scan.word_hashes(block, found))
    ends = np.cumsum(lengths)
    n_windows = np.maximum(lengths - WINDOW + 1, 1)
    piece = np.repeat(np.arange(len(rows)), n_windows)
    first = np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + (ends - lengths)[piece]
    size = np.minimum(lengths, WINDOW)[piece]
    names, item = np.unique(np.array([i for i, _ in rows], object), return_inverse=True)
    distinct, at, window = np.unique(hashes.windows(first, first + size), return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([window, item[piece]], 1), axis=0)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    owners = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pairs[:, 1], pa.int32()))
    columns = {
        "windows": {"hash": pa.array(distinct), "first": pa.array(first[at]), "size": pa.array(size[at]), "owners": owners},
        "words": {"word": pa.array(words, pa.binary())},
        "items": {"item": pa.array(names.tolist(), pa.string())},
    }
    paths = []
    for name, table in columns.items():
        paths.append(f"{folder}/{token}-{number}-{name}.feather")
        feather.write_feather(pa.table(table), paths[-1], compression="uncompressed")
    return paths, set(size[at].tolist())


def read_part(token: str, number: int, locate: Callable[[str], str]) -> Part:
    """Map the files of a part into memory; only what is looked at is read."""

    def table(name: str) -> pa.Table:
        return feather.read_table(locate(f"{token}-{number}-{name}.feather"), memory_map=True)

    windows = table("windows")
    hashes, first, size = (windows.column(c).to_numpy() for c in ("hash", "first", "size"))
    owners = windows.column("owners").combine_chunks()
    return Part(hashes, first, size, owners, table("words").column(0).combine_chunks(), table("items").column(0).combine_chunks())


_opened: dict[tuple[str, int], Part] = {}  # of this worker; mapped files take no heap


def opened(token: str, number: int) -> Part:
    if any(known != token for known, _ in _opened):
        _opened.clear()
    if (token, number) not in _opened:
        _opened[token, number] = read_part(token, number, SparkFiles.get)
    return _opened[token, number]


def matching(hashes: scan.Hashes, found: scan.Words, sizes: list[int], parts: list[Part]) -> dict[tuple[bytes, ...], set[str]]:
    """The windows whose hash occurs in a block, word by word, with the items they are of."""
    left = np.repeat(found.bounds[1:], np.diff(found.bounds)) - np.arange(len(found.starts))
    seen = []
    for size in sizes:
        starts = np.flatnonzero(left >= size)
        seen.append(hashes.windows(starts, starts + size))
    distinct = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for part in parts:
        for window in part.windows(distinct).tolist():
            owners.setdefault(part.sequence(window), set()).update(part.names(window))
    return owners


def _runs(flags: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; runs end at `cuts` too."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[cuts] = True
    begins, ends = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1] | edge[1:-1]
    ends[:-1] &= ~flags[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def scan_block(block: scan.Block, sizes: list[int], parts: list[Part]) -> list[dict]:
    found = scan.words(block, scan.not_alphanumeric())
    values = scan.word_hashes(block, found, lower=True)
    owners = matching(scan.Hashes(values), found, sizes, parts)
    change = np.zeros(len(values) + 1, np.int64)
    items: dict[int, set[str]] = {}
    if owners:
        automaton = Automaton(owners)
        known = pc.is_in(pa.array(values), _hashes_of(automaton.number)).to_numpy(zero_copy_only=False)
        data = block.data.tobytes().lower()  # of bytes, so only A-Z change
        starts, ends = _runs(known, found.bounds)
        long = ends - starts >= max(1, automaton.shortest)
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            spans = zip(found.starts[start:end].tolist(), found.ends[start:end].tolist())
            numbers = automaton.numbers([data[a:z] for a, z in spans])
            for last, (size, names) in automaton.machine.iter(tuple(numbers.tolist())):
                change[start + last + 1 - size] += 1
                change[start + last + 1] -= 1
                items.setdefault(int(found.text[start]), set()).update(names)
    hit = np.cumsum(change[:-1]) > 0
    n_words = np.diff(found.bounds)
    rows = [{"n_words": n, "n_hit": 0, "spans": [], "items": []} for n in n_words.tolist()]
    if items:
        chars = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
        for start, end in zip(*(x.tolist() for x in _runs(hit, found.bounds))):
            row = found.text[start]
            first, origin = found.bounds[row], chars[block.starts[row]]
            rows[row]["n_hit"] += end - start
            rows[row]["spans"].append(
                {
                    "word_start": start - first,
                    "word_end": end - first,
                    "char_start": chars[found.starts[start]] - origin,
                    "char_end": chars[found.ends[end - 1]] - origin,
                }
            )
    for row, owners in items.items():
        rows[row]["items"] = sorted(owners)
    return rows


def _hashes_of(words: dict[bytes, int]) -> pa.Array:
    block = next(scan.blocks(pa.array(list(words), pa.binary()), 1 << 60))
    return pa.array(scan.Hashes(scan.byte_values()[block.data]).windows(block.starts[:-1], block.starts[1:]))


def _scanner(token: str, n_parts: int, sizes: list[int], text: str, out: str, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [opened(token, number) for number in range(n_parts)]
        for batch in batches:
            rows: list[dict] = []
            for block in scan.blocks(batch.column(text)):
                rows += scan_block(block, sizes, parts)
            result = pa.array(rows, ARROW_RESULT)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, result], names=[*keep, out])

    return run


ARROW_SPAN = pa.struct([(n, pa.int64()) for n in ("word_start", "word_end", "char_start", "char_end")])
ARROW_RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(ARROW_SPAN)),
        ("items", pa.list_(pa.string())),
    ]
)


def item_pieces(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Normalised words of the items; long items in pieces that overlap by a window less one word."""
    lowered = F.translate(
        F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    words = F.regexp_extract_all(lowered, F.lit(NORMAL_WORD), F.lit(0))
    return (
        items.select(
            F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
            words.alias("words"),
        )
        .filter(F.size("words") > 0)
        .withColumn("at", F.explode(F.expr(f"sequence(0, size(words) - 1, {PIECE_WORDS})")))
        .filter((F.col("at") == 0) | (F.col("at") + WINDOW <= F.size("words")))
        .select("item", "at", F.expr(f"slice(words, at + 1, {PIECE_WORDS + WINDOW - 1})").alias("words"))
    )


def _parts(spark: SparkSession, pieces: DataFrame, part_bytes: int) -> tuple[str, int, list[int]]:
    """Write the window files part by part and hand them to Spark; (token, parts, window sizes)."""
    size = pieces.agg(F.sum(F.octet_length(F.array_join("words", " ")))).first()[0] or 0
    n_parts = max(1, -(-size // part_bytes))
    number = F.pmod(F.xxhash64("item", "at"), F.lit(n_parts))
    token, folder, sizes = uuid.uuid4().hex, tempfile.mkdtemp(prefix="inkferry-windows-"), set()
    for part in range(n_parts):
        rows = [(r.item, r.words) for r in pieces.filter(number == part).select("item", "words").collect()]
        paths, own = write_part(rows, folder, token, part)
        sizes |= own
        for path in paths:
            spark.sparkContext.addFile(path)
    return token, n_parts, sorted(sizes)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "contamination",
    keep: list[str] | None = None,
    automaton_bytes: int = PART_BYTES,
) -> DataFrame:
    """Add to each row a struct (n_words, n_hit, spans, items) about the item windows in its text.

    A window is 13 consecutive words of an item, or all words of a shorter one; a word inside any
    occurrence is hit. `spans` are the maximal runs of hit words, in words and in code points of the
    original text; `items` the ids, as strings, of the items with an occurrence.

    The windows go to the executors as files, in parts of about `automaton_bytes` of item text; the
    driver holds one part at a time, and executors need about 60 bytes of disk per word of the items.
    The texts are read once, whatever the number of parts, and not shuffled.

    Null and empty texts have no words and no hits. Items without words match nothing; a null item id
    counts as ''; items that share an id count once. Repeated rows are judged one by one. A column
    already named `out` is replaced. Empty tables give empty results, or no hits.
    """
    spark = ready(docs.sparkSession)
    columns = [c for c in (keep if keep is not None else docs.columns) if c != out]
    token, n_parts, sizes = _parts(spark, item_pieces(items, item_id, item_text), automaton_bytes)
    schema = T.StructType([docs.schema[c] for c in columns]).add(out, T._parse_datatype_string(RESULT))
    needed = docs.select(*dict.fromkeys([*columns, text]))
    return needed.mapInArrow(_scanner(token, n_parts, sizes, text, out, columns), schema)


def is_contaminated(out: str = "contamination"):
    """A twentieth of the words or more repeat an item."""
    return (F.col(f"{out}.n_hit") > 0) & (20 * F.col(f"{out}.n_hit") >= F.col(f"{out}.n_words"))

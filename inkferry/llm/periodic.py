"""Runs of words with a small period, found by block convolution.

A run of period q and at least 4 q words holds, for the power of two L with L <= q < 2 L, two neighbouring
blocks [j L, j L + L) that occur again q words on. So for each L every block is laid over the window
that follows it, at all distances of L to 2 L - 1 at once: the sum of squared differences of the word
numbers is a correlation, computed by a number-theoretic transform modulo as many primes as its
largest value needs, and a distance counts where the sum is exactly zero. Those distances are seeds:
each is extended to the left and to the right as far as the words agree, and what is long enough and
has no smaller period is a run.

Two exact shortcuts leave convolutions out: a block whose first words do not come again at these
distances has no match, and a block that lies with its whole window in a run already found matches only
at multiples of that run's period, which give the same run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm import scan
from inkferry.llm.common import ready

LEAST_WORDS = 6
LEAST_REPEATS = 4
BLOCK_WORDS = 200_000  # of several texts in one array; a longer text is an array of its own
BATCH_CELLS = 1 << 20  # of blocks transformed at once
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))  # 2**26 divides each less one; a generator
RESULT = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept string"

_roots: dict[tuple[int, int, bool], list[np.ndarray]] = {}


def _twiddles(prime: int, generator: int, n: int, back: bool) -> list[np.ndarray]:
    """Powers of the roots of unity for the layers of a transform of length n."""
    if (prime, n, back) not in _roots:
        layers, size = [], n
        while size > 1:
            root = pow(generator, (prime - 1) // size, prime)
            root = pow(root, -1, prime) if back else root
            powers = np.ones(size // 2, np.uint64)
            filled, step = 1, root
            while filled < len(powers):  # doubling: the next powers are the known ones times root**filled
                powers[filled : 2 * filled] = powers[:filled] * np.uint64(step) % np.uint64(prime)
                filled, step = 2 * filled, step * step % prime
            layers.append(powers)
            size //= 2
        _roots[prime, n, back] = layers
    return _roots[prime, n, back]


def _forward(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transform each row; the result is in bit-reversed order."""
    n, p = rows.shape[1], np.uint64(prime)
    a = rows
    for powers in _twiddles(prime, generator, n, False):
        half = len(powers)
        a = a.reshape(len(rows), -1, 2, half)
        low, high = a[:, :, 0], a[:, :, 1]
        a = np.stack([(low + high) % p, (low + p - high) % p * powers % p], axis=2)
    return a.reshape(rows.shape)


def _backward(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Undo `_forward`, from bit-reversed order."""
    n, p = rows.shape[1], np.uint64(prime)
    a = rows
    for powers in reversed(_twiddles(prime, generator, n, True)):
        half = len(powers)
        a = a.reshape(len(rows), -1, 2, half)
        low, high = a[:, :, 0], a[:, :, 1] * powers % p
        a = np.stack([(low + high) % p, (low + p - high) % p], axis=2)
    return a.reshape(rows.shape) * np.uint64(pow(n, -1, prime)) % p


def zero_distances(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each block of `size` words: at which of the distances size to 2 size - 1 it occurs again.

    `words` are numbers from 0 and reach 3 `size` - 1 words behind each start. One row per block.
    """
    place = np.arange(2 * size)
    blocks = words[starts[:, None] + place[:size]].astype(np.uint64)
    windows = words[starts[:, None] + size + place[: 2 * size - 1]].astype(np.uint64)
    zero, bound, reached = np.ones((len(starts), size), bool), size * int(words.max()) ** 2 + 1, 1
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        x = np.zeros((len(starts), 2 * size), np.uint64)
        x[:, -place[:size]] = blocks % p  # reversed in time, so that the product is a correlation
        y = np.zeros_like(x)
        y[:, : 2 * size - 1] = windows % p
        cross = _forward(x, prime, generator) * _forward(y, prime, generator) % p
        cross = _backward(cross, prime, generator)[:, :size]
        sums = np.zeros((len(starts), 2 * size), np.uint64)
        np.cumsum(y[:, : 2 * size - 1] * y[:, : 2 * size - 1] % p, axis=1, out=sums[:, 1:])
        squares = (sums[:, size : 2 * size] - sums[:, :size]) % p
        squares += (x * x % p).sum(axis=1, keepdims=True) % p
        zero &= squares % p == cross * np.uint64(2) % p
        reached *= prime
        if reached > bound:
            return zero
    raise ValueError("a text has more different words than the transforms are exact for")


def _again(words: np.ndarray, grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Starts whose gram occurs again at a distance of size to 2 size - 1; `grams` sorts gram, then place."""
    if size == 1:
        return starts[words[starts] == words[starts + 1]]
    n = len(words) + 1
    group = grams[1]
    low = np.searchsorted(grams[0], group[starts] * n + starts + size)
    found = grams[0][np.minimum(low, len(grams[0]) - 1)]
    return starts[(low < len(grams[0])) & (found < group[starts] * n + starts + 2 * size)]


def _grams(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted group * n + place, group of each place) for runs of `size` words; hashes only group."""
    n = len(words)
    found = scan.Hashes(scan.mixed(words.astype(np.uint64) + np.uint64(1)))
    places = np.arange(max(0, n - size + 1))
    _, groups = np.unique(found.windows(places, places + size), return_inverse=True)
    return np.sort(groups * (n + 1) + places), groups


def _reach(found: scan.Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
    """How many words agree from (a, b) on, ahead or back, by halving on the hashes of windows."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        if ahead:
            same = found.windows(a, a + mid) == found.windows(b, b + mid)
        else:
            same = found.windows(a - mid, a) == found.windows(b - mid, b)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _prime_divisors(n: int) -> list[int]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return found + [n] * (n > 1)


def find_runs(words: np.ndarray, spans: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) in an array of word numbers; `spans` is the longest text's length.

    Texts in one array must be apart by numbers that occur once, so that nothing matches across.
    """
    top = int(words.max(initial=0)) + 1  # windows of the last blocks reach behind the end
    words = np.append(words, top + np.arange(spans // 2 + 2))
    n = len(words)
    runs: set[tuple[int, int, int]] = set()
    found = grams = None
    size = 1
    while LEAST_REPEATS * size <= spans:
        starts = np.arange(0, max(0, n - 3 * size + 2), size)
        if size in (2, 4):
            grams = _grams(words, size)
        starts = _again(words, grams, starts, size)
        starts = starts[~_inside(runs, starts, size)]
        step = max(1, BATCH_CELLS // (2 * size))
        blocks, distances = [], []
        for first in range(0, len(starts), step):
            part = starts[first : first + step]
            row, distance = np.nonzero(zero_distances(words, part, size))
            blocks.append(part[row])
            distances.append(distance + size)
        if blocks and sum(map(len, blocks)):
            at, d = np.concatenate(blocks), np.concatenate(distances)
            order = np.lexsort((at, d))
            at, d = at[order], d[order]
            joined = np.append(False, (np.diff(at) == size) & (np.diff(d) == 0))
            heads = ~joined & np.append(joined[1:], False)  # the first of neighbouring matches
            if heads.any():
                if found is None:
                    found = scan.Hashes(scan.mixed(words.astype(np.uint64) + np.uint64(1)))
                runs.update(_extended(words, found, at[heads], d[heads]))
        size *= 2
    return sorted(runs)


def _inside(runs: set[tuple[int, int, int]], starts: np.ndarray, size: int) -> np.ndarray:
    """Which blocks lie, window and all, in one run already found."""
    inside = np.zeros(len(starts), bool)
    for low, high, _ in runs:
        a, z = np.searchsorted(starts, [low, high - 3 * size + 2])
        inside[a : max(a, z)] = True
    return inside


def _extended(words: np.ndarray, found: scan.Hashes, at: np.ndarray, d: np.ndarray):
    """Runs around the seeds: words at `at` agree with those `d` later, for a block's length."""
    n = len(words)
    ahead = _reach(found, at, at + d, n - at - d, True)
    back = _reach(found, at, at + d, at, False)
    lows, highs = at - back, at + d + ahead
    long = highs - lows >= np.maximum(LEAST_WORDS, LEAST_REPEATS * d)
    seeds = dict(zip(zip(lows[long].tolist(), highs[long].tolist(), d[long].tolist()), at[long].tolist()))
    for (low, high, period), seed in seeds.items():
        if not _has_period(words, low, high, period):  # equal hashes of unequal words: go word by word
            low, high = seed, seed + period
            while high < n and words[high] == words[high - period]:
                high += 1
            while low and words[low - 1] == words[low - 1 + period]:
                low -= 1
            if high - low < max(LEAST_WORDS, LEAST_REPEATS * period):
                continue
        if not any(_has_period(words, low, high, period // r) for r in _prime_divisors(period)):
            yield low, high, period


def _has_period(words: np.ndarray, low: int, high: int, period: int) -> bool:
    return bool((words[low : high - period] == words[low + period : high]).all())


@dataclass
class Texts:
    """Words of some texts in one array, apart by numbers of their own."""

    words: list[list[bytes]]

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        known: dict[bytes, int] = {}
        starts, flat = [], []
        for found in self.words:
            starts.append(len(flat))
            flat += [known.setdefault(w, len(known)) for w in found]
            flat.append(-1)
        numbers = np.array(flat, np.int64)
        ends = numbers < 0
        numbers[ends] = len(known) + np.arange(ends.sum())
        return numbers, np.array([*starts, len(flat)])

    def judged(self) -> Iterator[dict]:
        """Per text: how many words, its runs, and the words left when each run keeps one period."""
        numbers, starts = self.numbers()
        runs = find_runs(numbers, max(map(len, self.words), default=0))
        gone = np.zeros(len(numbers) + 1, np.int64)
        for low, high, period in runs:
            gone[low + period] += 1
            gone[high] -= 1
        gone = np.cumsum(gone) > 0
        texts = np.searchsorted(starts, [low for low, _, _ in runs], "right") - 1
        of_text: dict[int, list] = {}
        for text, (low, high, period) in zip(texts.tolist(), runs):
            start = int(low - starts[text])
            of_text.setdefault(text, []).append({"start": start, "length": high - low, "period": period})
        for text, found in enumerate(self.words):
            kept = found
            if text in of_text:
                out = gone[starts[text] : starts[text] + len(found)]
                kept = [w for w, drop in zip(found, out.tolist()) if not drop]
            yield {"n_words": len(found), "runs": of_text.get(text, []), "kept": b" ".join(kept).decode()}


def _finder(text: str, columns: list[str], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, words, size = batch.column(text), 0, [], 0
            for row in range(len(batch)):
                words.append((texts[row].as_py() or "").encode().split())  # at the six ASCII spaces
                size += len(words[-1])
                if size >= BLOCK_WORDS or row == len(batch) - 1:
                    made = pa.array(Texts(words).judged(), schema.field(-1).type)
                    rows = batch.slice(first, row + 1 - first)
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), made], schema=schema)
                    first, words, size = row + 1, [], 0

    return run


def repeated_runs(
    docs: DataFrame, text: str = "text", out: str = "periodic", keep: list[str] | None = None
) -> DataFrame:
    """Add a struct (n_words, runs, kept) about the periodic runs of words in every whole text.

    Words are maximal runs of characters other than space and \\t to \\r. A run is a stretch with smallest
    period q and max(6, 4 q) words or more, as long as the period lasts on both sides; runs may overlap.
    `runs` are sorted by start, then period; `kept` are the words, joined by one space, without those
    that follow the first q words of a run.

    Null and empty texts have no words, no runs and an empty `kept`. Rows are judged one by one, repeated
    ones too; an empty table gives an empty one. A column already named `out` is replaced. Memory of a
    task: a batch of texts and some hundred bytes for each word of the longest text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ready(docs.sparkSession)
    columns = [c for c in (keep if keep is not None else docs.columns) if c != out]
    schema = T.StructType([docs.schema[c] for c in columns]).add(out, T._parse_datatype_string(RESULT))
    run = _finder(text, columns, to_arrow_schema(schema))
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def longest_run(out: str = "periodic") -> Column:
    """The longest of a text's runs, of equal ones the first, then the one of smallest period; or null."""
    ranked = F.transform(
        f"{out}.runs", lambda r: F.struct(-r.length, r.start, r.period, r.alias("run"))
    )
    return F.array_min(ranked)["run"]


def with_loops(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Let a tenth of the texts end in a loop, chosen and shaped by the key's crc32, for measuring.

    A null key counts as ''; a text without words stays. The words of a changed text are joined by one
    space.
    """
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    looped = F.expr(
        """transform(sequence(0, _n - 1), i -> element_at(_words, cast(1 +
             if(i < _a, i, _a + (i - _a) % (1 + (_n - _a) div (3 + _g % 8))) as int)))"""
    )
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return (
        docs.withColumn("_h", h)
        .withColumn("_g", F.expr("_h div 10"))
        .withColumn("_words", F.when(F.expr("_h % 10 = 0"), words))
        .withColumn("_n", F.size("_words"))
        .withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
        .withColumn(text, F.when(F.col("_n") > 0, F.array_join(looped, " ")).otherwise(F.col(text)))
        .drop("_h", "_g", "_words", "_n", "_a")
    )

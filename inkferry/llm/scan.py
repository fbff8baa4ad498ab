"""Array code over batches of UTF-8 text: word bounds and window hashes, without a loop per word.

A block is a run of texts laid end to end. Hashes are polynomial prefix sums modulo 2**64 over random
64-bit values per byte, so any window's hash is two look-ups; equal windows have equal hashes wherever
they lie in a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # texts are handled in blocks of about this size; one long text is one block
SPACES = b" \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Block:
    first: int  # row of the batch that the block starts with
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # n + 1 offsets of the texts in `data`

    def __len__(self) -> int:
        return len(self.starts) - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string or binary array into blocks; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        low, high = int(offsets[row]), int(offsets[end])
        yield Block(row, data[low:high], offsets[row : end + 1] - low)
        row = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that high bits can choose a bucket."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_values(lower: bool = False) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**n; kept up to the usual block's length."""
    known = _powers.get(int(base))
    if known is None or len(known) <= n:
        known = np.full(max(n, 2 * BLOCK_BYTES) + 1, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 2 * BLOCK_BYTES:
            _powers[int(base)] = known
    return known[: n + 1]


class Hashes:
    """Hashes of any windows of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(powers(BASE, len(values))[:-1] * values, out=self.sums[1:])
        self.back = powers(BASE_INVERSE, len(values))

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.back[starts]
        h += (ends - starts).astype(np.uint64) * BASE
        return mixed(h)


def is_space() -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(SPACES)] = True
    return flags


def not_alphanumeric() -> np.ndarray:
    """Bytes outside 0-9, A-Z, a-z and the bytes of non-ASCII characters."""
    flags = np.ones(256, bool)
    flags[48:58] = flags[65:91] = flags[97:123] = flags[128:] = False
    return flags


@dataclass
class Words:
    starts: np.ndarray  # byte offsets in the block
    ends: np.ndarray
    text: np.ndarray  # index of the word's text in the block
    bounds: np.ndarray  # n + 1 word numbers where the texts begin


def words(block: Block, breaks: np.ndarray) -> Words:
    """Maximal runs of bytes that are no breaks; runs end with their text."""
    inside = ~breaks[block.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[block.starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, block.starts)
    text = np.repeat(np.arange(len(block)), np.diff(bounds))
    return Words(starts, np.flatnonzero(stops) + 1, text, bounds)


def word_hashes(block: Block, found: Words, lower: bool = False) -> np.ndarray:
    return Hashes(byte_values(lower)[block.data]).windows(found.starts, found.ends)

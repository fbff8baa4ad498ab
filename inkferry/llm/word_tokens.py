"""Token ids of whole texts for a word-end BPE vocabulary, equal to the tokenizers library's.

Most texts repeat words, so ids are found once per distinct chunk between spaces and gathered by array
code. Texts outside Latin letters, where normalisation may look across characters, and texts that
spell a special token go through the library itself.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkferry.llm import scan

WORD_END = b"\xff"  # stands for the end-of-word mark; no UTF-8 text has this byte
FIRST_OTHER = 0xCC  # lead bytes from here on start characters from U+0300
KEPT_PIECES = 400_000
LONGEST_KEPT = 64
SENTENCE_MARKS = (".", ",")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordTokenizer:
    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_alphabet()
        end = spec["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            body, mark = (token[: -len(end)], WORD_END) if token.endswith(end) else (token, b"")
            return bytes(to_byte[c] for c in body) + mark

        specials = [t["content"] for t in spec["added_tokens"]]
        ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [ranks[raw(a) + raw(b)] for a, b in merges]
        closed = [ranks[bytes([b]) + WORD_END] for b in range(256)]
        # An id can serve as a merge's rank: a byte and the word end come first, then merges in order.
        if order != sorted(set(order)) or max(closed) > order[0]:
            raise ValueError("the ids of this vocabulary do not follow its merges")
        self.core = tiktoken._tiktoken.CoreBPE(ranks, {}, "(?s).+")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.specials = [s.encode() for s in specials]
        self.known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of a lower-case run of letters or signs, as 16-bit numbers."""
        known = self.known.get(text)
        if known is None:
            known = array("H", self.core.encode_single_piece(text.encode() + WORD_END)).tobytes()
            if len(text) <= LONGEST_KEPT:
                if len(self.known) >= KEPT_PIECES:
                    self.known.clear()
                self.known[text] = known
        return known

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk without a space."""
        low = text.lower()
        if low.isalpha():
            return self.piece(low)
        if low[-1:] in SENTENCE_MARKS and low[:-1].isalpha():
            return self.piece(low[:-1]) + self.piece(low[-1])
        return b"".join([self.piece(p) for p in self.pieces(low)])

    def _by_library(self, block: scan.Block) -> np.ndarray:
        """Texts that chunks can't stand for."""
        other = np.add.reduceat(
            np.append(block.data >= FIRST_OTHER, False), np.minimum(block.starts[:-1], len(block.data))
        )
        odd = (other > 0) & (np.diff(block.starts) > 0)
        raw = block.data.tobytes()
        for mark in ("İ".encode(), *self.specials):
            at = raw.find(mark)
            while at >= 0:
                odd[np.searchsorted(block.starts, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        return odd

    def block_ids(self, block: scan.Block) -> list[np.ndarray]:
        odd = self._by_library(block)
        starts = block.starts.astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(
            len(block), pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(block.data))
        )
        chunks = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        found = [self.chunk(c) for c in coded.dictionary.to_pylist()]
        flat = np.frombuffer(b"".join(found), np.uint16)
        size = np.fromiter((len(x) // 2 for x in found), np.int64, len(found))
        codes = coded.indices.to_numpy()
        sizes = size[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        first = (np.cumsum(size) - size)[codes] - (ends - sizes) if len(codes) else sizes
        ids = flat[np.repeat(first, sizes) + np.arange(len(ends) and ends[-1])]
        bounds = np.concatenate(([0], ends))[chunks.offsets.to_numpy()]
        easy = iter(np.split(ids, bounds[1:-1]) if len(bounds) > 1 else ())
        hard = iter(())
        if odd.any():
            encoded = self.library.encode_batch(
                texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False
            )
            hard = iter([np.array(e.ids, np.uint32) for e in encoded])
        return [next(hard) if o else next(easy) for o in odd.tolist()]


def latin_is_stable() -> bool:
    """Below U+0300 nothing composes, which is what lets chunks stand for their text."""
    return all(unicodedata.normalize("NFC", chr(c)) == chr(c) for c in range(0x300))

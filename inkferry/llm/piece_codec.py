"""Encoding and decoding with a SentencePiece model whose pieces come from merges.

A sequence of pieces is what merging gives exactly if every two neighbours are: merged on their own,
their joined text falls into the same two pieces. So a text is encoded from left to right by the
longest piece at each place that is compatible with the piece before it; where none is, the last piece
is taken back and tried shorter. Each beginning of a text has one encoding, so a place from which the
search failed is marked in a bitfield and never entered again, and the work is linear in the text.
The longest pieces of all places come from one Aho-Corasick automaton over the reversed pieces, which
reads the text once from its end.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm.common import ready

SPACE = "▁"  # stands for a space inside pieces
LONGEST_KEPT = 64  # code points of a part or chunk whose ids are remembered
KEPT_PARTS = 300_000  # in each of two generations; the memory of a task stays bounded
KEPT_PAIRS = 250_000  # of neighbouring pieces, known to be compatible or not
FLUSH_IDS = 2_000_000  # in one output batch, if texts are short
PIECES = "ids array<int>, n_tokens bigint"
# Piece types of the model format, and what decoding an unknown or broken part gives
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BROKEN = "�".encode()


@dataclass(frozen=True)
class Model:
    """The parts of a model file that encoding and decoding need; small, and sent to the workers."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    unknown_id: int
    unknown_text: str
    dummy_prefix: bool
    extra_spaces: bool  # are runs of spaces removed
    byte_fallback: bool


def load(path: str) -> Model:
    """Read a model file on the driver. Only merge models that leave the text's characters as they are."""
    from sentencepiece import sentencepiece_model_pb2 as formats

    proto = formats.ModelProto()
    with open(path, "rb") as source:
        proto.ParseFromString(source.read())
    trainer, normal = proto.trainer_spec, proto.normalizer_spec
    types = tuple(p.type for p in proto.pieces)
    if trainer.model_type != trainer.BPE or normal.precompiled_charsmap or trainer.treat_whitespace_as_suffix:
        raise ValueError("a merge model with the identity normalisation and space as prefix is needed")
    if not normal.escape_whitespaces or {UNUSED, USER_DEFINED} & set(types):
        raise ValueError("models with unused or user-defined pieces, or with bare spaces, are not supported")
    return Model(
        tuple(p.piece for p in proto.pieces),
        tuple(p.score for p in proto.pieces),
        types,
        trainer.unk_id,
        trainer.unk_surface,
        normal.add_dummy_prefix,
        normal.remove_extra_whitespaces,
        trainer.byte_fallback,
    )


class Encoder:
    """Pieces by number: their ids in the model and, behind those, characters that are no piece."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        normal = [i for i, t in enumerate(model.types) if t == NORMAL]
        self.ids = {model.pieces[i]: i for i in normal}
        self.scores = {model.pieces[i]: model.scores[i] for i in normal}
        self.names = list(model.pieces)
        self.sizes = [len(p) for p in model.pieces]
        self.shorter = [model.unknown_id] * len(model.pieces)  # a piece's longest beginning; or none
        self.nothing = model.unknown_id  # a number that no text has
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1:
                begins = (self.ids.get(piece[:n]) for n in range(len(piece) - 1, 0, -1))
                begin = next((b for b in begins if b is not None), None)
                self.shorter[i] = self.other(piece[0]) if begin is None else begin
            self.automaton.add_word(piece[::-1], i)
        self.automaton.make_automaton()
        self.pairs = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = [0] * 256
        for i, kind in enumerate(model.types):
            if kind == BYTE:
                self.bytes[int(model.pieces[i][1:-1], 16)] = i
        # no piece goes on with a space after another character: such places are always bounds
        bounded = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if bounded else "(?s).+").findall

    def other(self, character: str) -> int:
        """Number of a character that is no piece."""
        if character not in self.ids:
            self.ids[character] = len(self.names)
            self.names.append(character)
            self.sizes.append(1)
            self.shorter.append(self.model.unknown_id)
        return self.ids[character]

    def merged(self, text: str) -> list[str]:
        """Merge single characters: always the pair with the best score, the leftmost of equal ones."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Do both stay as they are when merged together? After nothing: does the right one alone?"""
        two = [self.names[i] for i in (left, right) if i != self.nothing]
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        fit = self.fits[left << 32 | right] = self.merged("".join(two)) == two
        return fit

    def longest(self, text: str) -> list[int]:
        """The longest piece at each place; the character itself where no piece begins."""
        found, last, sizes = [-1] * len(text), len(text) - 1, self.sizes
        for end, piece in self.automaton.iter(text[::-1]):
            at = last - end
            if found[at] < 0 or sizes[piece] > sizes[found[at]]:
                found[at] = piece
        if -1 in found:
            return [self.other(c) if piece < 0 else piece for piece, c in zip(found, text)]
        return found

    def split(self, text: str) -> list[int]:
        """The pieces of a chunk, by search with backtracking."""
        longest, n, nothing = self.longest(text), len(text), self.nothing
        fits, shorter, sizes = self.fits, self.shorter, self.sizes
        failed = bytearray(n // 8 + 1)
        found: list[int] = []
        before, at, piece = nothing, 0, longest[0]
        while at < n:
            end = at + sizes[piece]
            if not failed[end >> 3] >> (end & 7) & 1:
                fit = fits.get(before << 32 | piece)
                if fit if fit is not None else self.compatible(before, piece):
                    found.append(piece)
                    before, at = piece, end
                    piece = longest[at] if at < n else nothing
                    continue
            piece = shorter[piece]
            while piece == nothing:
                failed[at >> 3] |= 1 << (at & 7)
                last = found.pop()
                at -= sizes[last]
                piece = shorter[last]
                before = found[-1] if found else nothing
        return found

    def part_ids(self, text: str) -> bytes:
        """Ids of a part of a text whose bounds no piece crosses."""
        found = self.split(text)
        most = len(self.model.pieces)
        if max(found) >= most:
            spelled = []
            for i in found:
                if i < most:
                    spelled.append(i)
                elif self.model.byte_fallback:
                    spelled.extend(self.bytes[b] for b in self.names[i].encode())
                else:
                    spelled.append(self.model.unknown_id)
            found = spelled
        return array("i", found).tobytes()

    def remembered(self, text: str, make: Callable[[str], bytes]) -> bytes:
        """Remember what is short; what was not asked for again until the next spring cleaning goes."""
        found = self.known.get(text)
        if found is None:
            found = self.older.get(text)
            if found is None:
                found = make(text)
            if len(text) <= LONGEST_KEPT:
                if len(self.known) >= KEPT_PARTS:
                    self.known, self.older = {}, self.known
                self.known[text] = found
        return found

    def chunk_ids(self, text: str) -> bytes:
        """Ids of a chunk, cut where two characters are neighbours in no piece."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs]
        if not cuts:
            return self.part_ids(text)
        ends = zip([0, *cuts], [*cuts, len(text)])
        return b"".join([self.remembered(text[a:z], self.part_ids) for a, z in ends])

    def encode(self, text: str) -> array:
        """Ids of a whole text."""
        if self.model.extra_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        out = array("i")
        if not text:
            return out
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        get, parts = self.known.get, []
        for chunk in self.chunks(text):
            found = get(chunk)
            if found is None:
                found = self.remembered(chunk, self.chunk_ids)
                get = self.known.get
            parts.append(found)
        out.frombytes(b"".join(parts))
        if not self.model.byte_fallback:  # neighbouring unknown characters are one unknown piece
            ids = np.frombuffer(out, np.int32)
            odd = ids == self.model.unknown_id
            out = array("i", ids[~(odd & np.append(False, odd[:-1]))].tobytes())
        return out


class Decoder:
    """The bytes of every piece."""

    def __init__(self, model: Model):
        self.model = model
        self.raw: list[bytes] = []
        for piece, kind in zip(model.pieces, model.types):
            if kind == BYTE:
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif kind == UNKNOWN:
                self.raw.append(model.unknown_text.encode())
            else:
                self.raw.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
        self.is_byte = np.array([t == BYTE for t in model.types])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces vanish, byte pieces join to characters, the dummy prefix goes."""
        raw = self.raw
        parts = [raw[i] for i in ids.tolist()]
        if self.model.dummy_prefix or self.model.extra_spaces:
            for n, i in enumerate(ids.tolist()):
                if self.model.types[i] != CONTROL:
                    if self.model.types[i] == NORMAL and parts[n].startswith(b" "):
                        parts[n] = parts[n].lstrip(b" ") if self.model.extra_spaces else parts[n][1:]
                    break
        spelled = np.flatnonzero(self.is_byte[ids]) if len(ids) else ids
        if len(spelled):
            for run in np.split(spelled, np.flatnonzero(np.diff(spelled) != 1) + 1):
                low, high = int(run[0]), int(run[-1]) + 1
                parts[low:high] = [_whole_characters(b"".join(parts[low:high])), *[b""] * (high - low - 1)]
        return b"".join(parts).decode()


def _whole_characters(data: bytes) -> bytes:
    """UTF-8 with each byte that belongs to no whole character replaced."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode().encode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(BROKEN)
            at += 1
    return b"".join(out)


_made: dict[tuple, Encoder | Decoder] = {}


def made(kind: type, model: Model) -> Encoder | Decoder:
    """One encoder and decoder per model and worker."""
    if (kind, model) not in _made:
        _made[kind, model] = kind(model)
    return _made[kind, model]


def _encoder(shared, text: str, columns: list[str], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made(Encoder, shared.value)
        for batch in batches:
            texts, first = batch.column(text), 0
            buffer, ends = array("i"), [0]
            for row in range(len(batch)):
                found = texts[row].as_py()
                if found:
                    buffer.extend(own.encode(found))
                ends.append(len(buffer))
                if len(buffer) >= FLUSH_IDS or row == len(batch) - 1:
                    offsets = np.array(ends, np.int32)
                    ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(buffer, np.int32)))
                    counts = pa.array(np.diff(offsets).astype(np.int64))
                    coded = pa.StructArray.from_arrays([ids, counts], fields=list(schema.field(-1).type))
                    rows = batch.slice(first, row + 1 - first)
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), coded], schema=schema)
                    buffer, ends, first = array("i"), [0], row + 1

    return run


def encode(
    docs: DataFrame, path: str, text: str = "text", out: str = "pieces", keep: list[str] | None = None
) -> DataFrame:
    """Add a struct (ids, n_tokens): the ids of every whole text, as the library's own encoder gives them.

    Null and empty texts have no ids. Repeated rows are encoded one by one, in any order; an empty table
    gives an empty one. Characters outside the vocabulary are spelled in byte pieces, or are unknown
    pieces in a model without those. Memory of a task: a batch of texts and their ids, and at most
    2 KEPT_PARTS remembered parts and KEPT_PAIRS pairs. A column already named `out` is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = ready(docs.sparkSession)
    columns = [c for c in (keep if keep is not None else docs.columns) if c != out]
    schema = T.StructType([docs.schema[c] for c in columns]).add(out, T._parse_datatype_string(PIECES))
    shared = spark.sparkContext.broadcast(load(path))  # the vocabulary
    run = _encoder(shared, text, columns, to_arrow_schema(schema))
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array column of ids; null ids give a null text, no ids an empty one.

    Ids outside the vocabulary raise an error. A column already named `out` is replaced.
    """
    spark = ready(df.sparkSession)
    shared = spark.sparkContext.broadcast(load(path))

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        own = made(Decoder, shared.value)
        flat = np.asarray(column.flatten())
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(own.raw):
            raise ValueError("an id is not in the vocabulary")
        sizes = np.asarray(column.value_lengths().fill_null(0))
        ends = np.cumsum(sizes)
        found = [own.decode(flat[z - n : z]) for n, z in zip(sizes.tolist(), ends.tolist())]
        return pa.array(found, pa.string(), mask=np.asarray(column.is_null()))

    return df.withColumn(out, texts(F.col(ids).cast("array<int>")))

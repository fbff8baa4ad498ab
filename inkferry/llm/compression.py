"""A quality classifier from compressed sizes.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is cut into
short chunks, each compressed with either dictionary; the difference of the two sums over the larger
one says which kind it resembles, and a logistic curve makes a probability of it.

What is compressed is the text's outline: letters by case, digits as one digit, a word that repeats the
word before it and a line that repeats an earlier line as one mark. Chunks are short so that a text can
only be described by the dictionary, not by its own beginning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm.common import crc_fold, ready

SAMPLE_DOCS = 4000  # labelled texts of each class to learn from, about; a bound on what is collected
CHUNK_BYTES = 128
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
THRESHOLD = 0.3

_MARKS = bytearray(range(256))
_MARKS[97:123] = b"a" * 26
_MARKS[65:91] = b"A" * 26
_MARKS[48:58] = b"0" * 10
_MARKS[0xC0:] = b"a" * 64
_MARKS = bytes(_MARKS)
_FOLLOWING = bytes(range(0x80, 0xC0))


def outline(text: bytes) -> bytes:
    out, seen, previous = [], set(), None
    for line in text.split(b"\n"):
        if not line:
            continue
        if line in seen:
            out.append(b"~")
            continue
        seen.add(line)
        marks = []
        for word, shape in zip(line.split(), line.translate(_MARKS, _FOLLOWING).split()):
            marks.append(b"=" if word == previous else shape)
            previous = word
        out.append(b" ".join(marks))
    return b"\n".join(out)


def chunks(data: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


class SizeDifference:
    """Compressed-size difference of a text between two dictionaries, from -1 to 1."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(dictionary: bytes):
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=0,
                write_checksum=0,
                write_dict_id=0,
            )
            content = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            return zstandard.ZstdCompressor(dict_data=content, compression_params=params).compress

        self.good, self.bad = compressor(good), compressor(bad)

    def of(self, text: bytes) -> float:
        good = bad = 0
        for chunk in chunks(outline(text)):
            good += len(self.good(chunk))
            bad += len(self.bad(chunk))
        return (bad - good) / max(good, bad, 1)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the joined samples where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-size:]


def _per_batch(text: str, columns: list[str], of: Callable[[bytes], object], kind: pa.DataType, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.large_binary())
            made = pa.array([of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], kind)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, made], names=[*columns, out])

    return run


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight pull of the slope to 0."""
    weights = np.zeros(2)
    design = np.column_stack([x, np.ones_like(x)])
    pull = np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - pull @ weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + pull
        step = np.linalg.solve(hessian, gradient)
        weights += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(weights[0], 0.0)), float(weights[1])


class Model:
    """Dictionaries and the curve; small enough to travel with a task."""

    def __init__(self, good: bytes, bad: bytes, slope: float, intercept: float):
        self.good, self.bad, self.slope, self.intercept = good, bad, slope, intercept

    def score(self, difference):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(difference * self.slope + self.intercept)))


def _sampled_labels(labels: DataFrame, key: str, label: str, wanted: int) -> DataFrame:
    """About `wanted` labelled keys of each class, by a hash of the key; contradictory ones are left out."""
    clean = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(label).alias("_least"), F.max(label).alias("_label"))
        .filter(F.col("_least") == F.col("_label"))
        .select(key, "_label")
    )
    counts = {r["_label"]: r.n for r in clean.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = F.when(F.col("_label") == 1, min(1.0, wanted / max(1, counts.get(1, 0)))).otherwise(
        min(1.0, wanted / max(1, counts.get(0, 0)))
    )
    return clean.filter(place < shares)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
) -> Model:
    """Learn from a sample of about `sample_docs` labelled texts of each class (or all, if fewer).

    Three quarters of the sample make the dictionaries, the rest the curve, so that the curve is not
    fitted to texts that the dictionaries know. The sample's keys are broadcast and the outlines of its
    whole texts are collected, whatever the size of the tables. Repeated rows of a key count once. Without both classes, scores are the share of good labels (or 0.5 without any).
    """
    ready(docs.sparkSession)
    chosen = _sampled_labels(labels.select(key, label), key, label, sample_docs)
    texts = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key)
    use = (F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(4)) > 0).alias("_dictionary")
    part = texts.select("_label", use, key, "_text")
    shape = T.StructType([part.schema[c] for c in ("_label", "_dictionary", key)])
    cut = part.filter("_dictionary").mapInArrow(
        _per_batch("_text", shape.names, outline, pa.binary(), "_outline"),
        T.StructType([*shape.fields, T.StructField("_outline", T.BinaryType())]),
    )
    once = cut.groupBy(key).agg(F.min("_label").alias("_label"), F.min("_outline").alias("_outline"))
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for row in once.orderBy(key).collect():
        samples[row["_label"]] += [c for c in chunks(bytes(row["_outline"])) if len(c) >= 8]
    if not samples[0] or not samples[1]:
        good = chosen.agg(F.avg("_label")).first()[0]
        odds = np.clip(0.5 if good is None else good, 0.01, 0.99)
        return Model(b"", b"", 0.0, float(np.log(odds / (1 - odds))))
    good, bad = (train_dictionary(samples[c], DICTIONARY_BYTES) for c in (1, 0))
    rest = _differences(part.filter("NOT _dictionary"), good, bad, "_text", shape.names, "_difference")
    held = rest.groupBy(key).agg(F.min("_label").alias("y"), F.min("_difference").alias("x"))
    pairs = np.array([(r.x, r.y) for r in held.collect()], float).reshape(-1, 2)
    slope, intercept = _fit_logistic(pairs[:, 0], pairs[:, 1]) if len(pairs) else (10.0, 0.0)
    return Model(good, bad, slope, intercept)


def _differences(
    docs: DataFrame, good: bytes, bad: bytes, text: str, columns: list[str], out: str
) -> DataFrame:
    token = uuid.uuid4().hex

    def of(data: bytes) -> float:
        if token not in _measures:
            _measures.clear()
            _measures[token] = SizeDifference(good, bad)
        return _measures[token].of(data)

    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField(out, T.DoubleType())])
    needed = docs.select(*dict.fromkeys([*columns, text]))
    return needed.mapInArrow(_per_batch(text, columns, of, pa.float64(), out), schema)


_measures: dict[str, SizeDifference] = {}  # of this worker, by token


def score(
    docs: DataFrame, model: Model, text: str = "text", out: str = "quality_score", keep: list[str] | None = None
) -> DataFrame:
    """Add the probability of a good label to every row; it depends on the whole text alone.

    Null and empty texts have no size difference and get the curve's value at 0. Repeated rows get equal
    scores. A column already named `out` is replaced; an empty table stays empty.
    """
    ready(docs.sparkSession)
    columns = [c for c in (keep if keep is not None else docs.columns) if c != out]
    measured = _differences(docs, model.good, model.bad, text, columns, out)
    return measured.withColumn(out, model.score(F.col(out)))


def training_rows(labels: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    return labels.filter(crc_fold(key, folds) != 0)

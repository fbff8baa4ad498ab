"""Language identification as inference of a mixture of languages.

Each language is a distribution over byte trigrams, counted on labelled texts. A text is explained as a
mixture: expectation-maximisation finds the languages' shares, and of the nested sets of languages by falling
share, of any size, the one with the best penalised likelihood is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm import scan
from inkferry.llm.common import ready

GRAM = 3
BUCKETS = 1 << 16  # of hashed trigrams for each language
MODEL_CELLS = 1 << 24  # all languages together; with many of them each gets fewer buckets
SMOOTHING = 0.5
TOLERANCE = 1e-4  # expectation-maximisation ends when no share moves by more
COUNTED_LANGUAGES = 64  # counted by a task at once
UNKNOWN = "und"

SHARES = "array<struct<lang:string,share:double>>"
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[:128] = 32
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[65:91] = np.arange(97, 123)


def grams(block: scan.Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram with a letter that lies inside a text, and its text's number."""
    data = _FOLDED[block.data].astype(np.uint32)
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    text = np.repeat(np.arange(len(block)), np.diff(block.starts))
    inside = (text[:-2] == text[2:]) & (codes != 0x202020)
    hashed = (codes[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    return hashed.astype(np.int64), text[:-2][inside]


def has_letter(block: scan.Block) -> list[bool]:
    ascii_letter = (_FOLDED[block.data] > 32) & (block.data < 128)
    counts = np.concatenate(([0], np.cumsum(ascii_letter)))
    found = (counts[block.starts[1:]] > counts[block.starts[:-1]]).tolist()
    for i in (i for i, f in enumerate(found) if not f):
        text = block.data[block.starts[i] : block.starts[i + 1]].tobytes().decode()
        found[i] = any(map(str.isalpha, text))
    return found


def _counter(buckets: int) -> Callable:
    def emit(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, row in counts.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(used), pa.string()),
                    pa.array(used.astype(np.int32)),
                    pa.array(row[used]),
                ],
                names=["lang", "bucket", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for block in scan.blocks(batch.column("text")):
                own = langs[block.first : block.first + len(block)]
                codes, text = grams(block, buckets)
                names = sorted(set(own))
                number = {lang: i for i, lang in enumerate(names)}
                by_text = np.array([number[lang] for lang in own])
                joint = np.bincount(by_text[text] * buckets + codes, minlength=len(names) * buckets)
                for lang, row in zip(names, joint.reshape(len(names), buckets)):
                    counts[lang] = counts[lang] + row if lang in counts else row
                if len(counts) > COUNTED_LANGUAGES:
                    yield from emit(counts)
                    counts.clear()
        yield from emit(counts)

    return run


class Model:
    """Languages in alphabetical order and the likelihood of every bucket in each."""

    def __init__(self, languages: list[str], likelihood: np.ndarray):
        self.languages, self.likelihood = languages, likelihood

    @property
    def buckets(self) -> int:
        return self.likelihood.shape[1]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram counts of every language over all rows with text and language.

    Counts are summed inside tasks and by bucket after that; the model has at most MODEL_CELLS numbers,
    whatever the corpus and the number of languages.
    """
    ready(docs.sparkSession)
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    languages = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    buckets = BUCKETS
    while buckets > 256 and buckets * len(languages) > MODEL_CELLS:
        buckets //= 2
    counts = np.zeros((len(languages), buckets))
    number = {name: i for i, name in enumerate(languages)}
    summed = (
        labelled.mapInArrow(_counter(buckets), "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    found = summed.toArrow()
    if len(found):
        names = found.column("lang").combine_chunks().dictionary_encode()
        rows = np.array([number[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()]
        counts[rows, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    counts += SMOOTHING
    return Model(languages, (counts / counts.sum(1, keepdims=True)).astype(np.float32))


def mixture(likelihood: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Shares of the languages, the log likelihood of gram counts `n` under them, and what none can exceed.

    The log likelihood is concave in the shares, so its gradient bounds that of all other shares.
    """
    likelihood = likelihood.astype(np.float64)
    shares = np.full(len(likelihood), 1 / len(likelihood))
    total = n.sum()
    moved = 1.0
    while moved > TOLERANCE:
        slope = likelihood @ (n / (shares @ likelihood)) / total
        moved = float(np.abs(shares * slope - shares).max())
        shares = shares * slope
    mixed = shares @ likelihood
    fit = float(n @ np.log(mixed))
    return shares, fit, fit + max(0.0, float((likelihood @ (n / mixed)).max() - total))


def languages_of(likelihood: np.ndarray, n: np.ndarray) -> list[tuple[int, float]]:
    """(language, share) of the best set, by falling share.

    Overlapping trigrams see each byte three times, so the likelihood counts a third; a further language
    has to earn half the logarithm of the number of trigrams. Sets grow until not even the bound on the
    likelihood of all languages together could pay for one more.
    """
    shares, _, most = mixture(likelihood, n)
    order = np.argsort(-shares, kind="stable")
    price = 0.5 * np.log(n.sum() + 1)
    best: list[tuple[int, float]] = []
    best_value = -np.inf
    for size in range(1, len(order) + 1):
        if most / GRAM - price * (size - 1) <= best_value:
            break
        chosen = order[:size]
        own, fit = mixture(likelihood[chosen], n)[:2] if size > 1 else (np.ones(1), float(n @ np.log(likelihood[chosen[0]])))
        value = fit / GRAM - price * (size - 1)
        if value > best_value:
            best_value = value
            ranked = np.argsort(-own, kind="stable")
            best = [(int(chosen[i]), float(own[i])) for i in ranked]
    return best


def _predictor(shared: Broadcast, text: str, keep: list[str], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            found: list[list[tuple[int, float]]] = []
            for block in scan.blocks(batch.column(text)):
                codes, number = grams(block, model.buckets)
                bounds = np.searchsorted(number, np.arange(len(block) + 1))
                for i, letters in enumerate(has_letter(block)):
                    used, n = np.unique(codes[bounds[i] : bounds[i + 1]], return_counts=True)
                    if not letters or not model.languages:
                        found.append([])
                    elif not len(used):  # letters, but too few bytes for a trigram
                        found.append([(0, 1 / len(model.languages))])
                    else:
                        found.append(languages_of(model.likelihood[:, used], n.astype(float)))
            names = model.languages
            made = [
                pa.array([names[f[0][0]] if f else UNKNOWN for f in found], pa.string()),
                pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                pa.array([[{"lang": names[i], "share": s} for i, s in f] for f in found], schema.types[-1]),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], schema=schema)

    return run


def identify(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add lang_pred, score (the language's share of the text) and languages (the whole mixture).

    Texts that are null, empty or without a letter get `und` and 0, as do all without a learned
    language. Of equal shares the alphabetically first wins. Repeated rows get equal answers; input
    columns named like a result are replaced; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = ready(docs.sparkSession)
    made = T._parse_datatype_string(f"lang_pred string, score double, languages {SHARES}")
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in made.names]
    schema = T.StructType([*[docs.schema[c] for c in columns], *made.fields])
    run = _predictor(spark.sparkContext.broadcast(model), text, columns, to_arrow_schema(schema))
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)

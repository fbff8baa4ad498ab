"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry.llm import compression, minhash, packing, suffixes
from inkferry.llm.common import staged, table, vocabulary
from inkferry.llm.decontaminate import decontaminate, is_contaminated


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. It learns from the labelled part of `docs`."""
    labels = compression.training_rows(table(spark, sf_dir, "labels"))
    model = compression.train(docs, labels)
    scored = compression.score(docs, model, out="_score")
    return scored.filter(F.col("_score") >= compression.THRESHOLD).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: the smallest id, without an id last, then any one row.

    Groups are of rows, not of ids: copies that share an id or have none are copies too, and two texts
    under one id are two documents. Rows without a word stay.
    """
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows, key="_row").select("_row", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    one = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first)
    return rows.join(one.select("first._row"), "_row", "left_semi").select(*docs.columns)


PASSAGE_WORDS = 51  # repeats of over fifty words go


def suffix_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out the passages of over fifty words that repeat; every document stays, maybe with an empty text."""
    done = suffixes.remove_repeats(
        docs, length=PASSAGE_WORDS, unit="words", as_text=True, keep=[c for c in docs.columns if c != "text"]
    )
    return done.withColumn("text", F.when(F.col("removal.n_bytes") >= 0, F.col("removal.kept"))).withColumn(
        "n_chars", F.length("text").cast("bigint")
    ).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more repeats benchmark items."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), out="_contamination")
    return found.filter(~is_contaminated("_contamination")).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 4096, one row per piece."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near deduplication", near_deduplication),
    ("suffix deduplication", suffix_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

ORACLE_SQL = None  # the stages learn, hash or search; tests hold them against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""How many words of a text survive a change of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.operators.skew import staged

WORD = r"[^\x20\x09-\x0D]+"
LOST = "array<struct<word:string,n:bigint>>"


def _words(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), none)


def _in_row(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, n_before, n_after, n_common, lost), each row by itself: nothing is shuffled.

    The words of both texts are sorted together, so equal words stand in a run, those before in front;
    a null key has no words. Each array is a step of its own, so that none is built again per word.
    """
    side = lambda text, s: F.transform(
        _words(F.when(F.col(key).isNotNull(), F.col(text))), lambda w: F.struct(w.alias("word"), F.lit(s).alias("side"))
    )
    sorted_ = rows.select(key, F.sort_array(F.concat(side(before, 0), side(after, 1))).alias("w"))
    places = F.sequence(F.lit(0), F.size("w") - 1)
    first = lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1))
    starts = F.when(F.size("w") > 0, F.filter(places, first)).otherwise(F.array().cast("array<int>"))
    started = sorted_.withColumn("s", starts)

    def run(start: Column, k: Column) -> Column:
        word = F.get("w", start)
        n = F.coalesce(F.get("s", k + 1), F.size("w")) - start
        return F.struct(word["word"].alias("word"), word["side"].alias("side"), n.cast("bigint").alias("n"))

    runs = started.select(key, F.transform("s", run).alias("r"))

    def left(word: Column, k: Column) -> Column:
        """How many of a word are there after: the next run's, if it is of the same word."""
        next_ = F.get("r", k + 1)
        n = F.when(next_["word"] == word["word"], next_["n"]).otherwise(F.lit(0).cast("bigint"))
        there = F.struct(word["word"].alias("word"), word["n"].alias("b"), F.coalesce(n, F.lit(0).cast("bigint")).alias("a"))
        return F.when(word["side"] == 0, there)

    zero = F.lit(0).cast("bigint")
    total = lambda array, value: F.aggregate(array, zero, lambda sum_, x: sum_ + value(x))
    met = runs.select(key, "r", F.filter(F.transform("r", left), lambda w: w.isNotNull()).alias("m"))
    gone = F.filter("m", lambda w: w["b"] > w["a"])
    return met.select(
        key,
        total("m", lambda w: w["b"]).alias("n_before"),
        total("r", lambda w: F.when(w["side"] == 1, w["n"]).otherwise(zero)).alias("n_after"),
        total("m", lambda w: F.least(w["b"], w["a"])).alias("n_common"),
        F.transform(gone, lambda w: F.struct(w["word"].alias("word"), (w["b"] - w["a"]).alias("n"))).cast(LOST).alias("lost"),
    )


def _over_rows(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """The same for keys of several rows, whose words count together; each of the rows has the key's result."""

    def words(column: str, weight: str) -> DataFrame:
        found = F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0))
        return rows.select(F.col(key), F.explode(found).alias("word"), *[F.lit(int(w == weight)).alias(w) for w in ("b", "a")])

    counts = (
        words(before, "b")
        .unionByName(words(after, "a"))
        .groupBy(key, "word")
        .agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    )
    gone = F.when(F.col("b") > F.col("a"), F.struct("word", (F.col("b") - F.col("a")).alias("n")))
    found = counts.groupBy(key).agg(
        F.sum("b").alias("n_before"),
        F.sum("a").alias("n_after"),
        F.sum(F.least("b", "a")).alias("n_common"),
        F.array_sort(F.collect_list(gone)).alias("lost"),
    )
    every = rows.select(key).join(found, key, "left").fillna(0, ["n_before", "n_after", "n_common"])
    return every.withColumn("lost", F.coalesce("lost", F.array().cast(LOST)))


def token_overlap(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, n_before, n_after, n_common, kept, lost) per row: the words of two text columns as multisets.

    `lost` lists the words that are rarer after than before, with how many went, sorted by word; `kept` is
    n_common / n_before, 1 for a text without words. A null text has no words. `key` should be unique: the
    texts of one row are compared where they are read, and only the rows of a repeated key are shuffled.
    """
    keys = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    repeated = staged(keys.filter(F.col(key).isNotNull()).select(key), "repeated-keys")
    if repeated.isEmpty():
        found = _in_row(rows, key, before, after)
    else:
        found = _in_row(rows.join(repeated, key, "left_anti"), key, before, after)
        found = found.unionByName(_over_rows(rows.join(repeated, key, "left_semi"), key, before, after))
    kept = F.when(F.col("n_before") == 0, F.lit(1.0)).otherwise(F.col("n_common") / F.col("n_before"))
    return found.select(key, "n_before", "n_after", "n_common", kept.alias("kept"), "lost")

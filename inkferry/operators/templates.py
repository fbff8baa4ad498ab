"""Message templates learned from the messages themselves.

Distinct messages fall into groups by their number of words. A group is split where one position takes
few values, each in several messages; positions that still differ in the end are wildcards. Only
distinct messages are compared; they stay where they are, and every step is an aggregation over
(group, position) or over the few words of a position that may split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkferry.operators.skew import checkpoint_dir, skew_join, staged

WILDCARD = "<*>"
MOST_VALUES = 20  # of a position that a group is split on
LEAST_MESSAGES = 2  # distinct messages per value of that position, on average
FEW_GROUPS = 10_000  # a table of so many fits any broadcast
ROUNDS = 8  # of splitting; every round settles one more position of each group


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread_by: str) -> DataFrame:
    """Join to a staged table by groups. Few groups are left to Spark, which hands them to every task, so the
    messages do not move; with many, hot groups are spread."""
    if right.count() <= FEW_GROUPS:
        return left.join(right, keys, how)
    return skew_join(left, right, keys, how, spread_by)


def _positions(groups: DataFrame, most_values: int) -> DataFrame:
    """(path, pos, values, messages, word): how many different words each group has at each position.

    `values` is exact up to `most_values`, above it any larger number; `word` is the only one if `values` is 1.
    Words are hashed to places in bitmaps first: as many words as places are there at least, so positions
    with too many places are done, and what is left has few words that partial sums fold.
    """
    maps = [f"_m{i}" for i in range(-(-max(most_values, 1) // 16))]
    each = groups.select("path", F.posexplode("words").alias("pos", "word"))
    place = F.pmod(F.xxhash64("word"), F.lit(64 * len(maps)))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    bits = [
        F.bit_or(F.when(F.floor(place / 64) == i, bit).otherwise(F.lit(0))).alias(m)
        for i, m in enumerate(maps)
    ]
    least = sum((F.bit_count(m).cast("bigint") for m in maps), F.lit(0).cast("bigint"))
    marked = each.groupBy("path", "pos").agg(F.count(F.lit(1)).alias("messages"), *bits)
    marked = staged(marked.select("path", "pos", "messages", least.alias("least")), "positions")
    few = marked.filter(F.col("least") <= max(most_values, 1)).select("path", "pos")
    words = _met(each, few, ["path", "pos"], "left_semi", "word").groupBy("path", "pos", "word").count()
    exact = words.groupBy("path", "pos").agg(F.count(F.lit(1)).alias("values"), F.min("word").alias("word"))
    return marked.join(exact, ["path", "pos"], "left").select(
        "path", "pos", F.coalesce("values", "least").alias("values"), "messages", "word"
    )


def _named(positions: DataFrame) -> DataFrame:
    """(path, template): the words that all messages of a group share, and wildcards."""
    word = F.when(F.col("values") == 1, F.col("word")).otherwise(F.lit(WILDCARD)).alias("word")
    parts = F.array_sort(F.collect_list(F.struct("pos", word)))  # as many as a message has words
    return positions.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["word"]), " ").alias("template"))


def learned_templates(
    messages: DataFrame,
    column: str = "error_message",
    most_values: int = MOST_VALUES,
    least_messages: int = LEAST_MESSAGES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(message, template, n): the template of every distinct message, and how many rows have it.

    Words are what white space separates. A position splits its group if it takes 2 to `most_values`
    values and each stands for `least_messages` messages on average; of several, the one with the fewest
    values, then the first. A template has the words that all its messages share and `<*>` elsewhere.
    A null message counts as '', and a message without words has the template ''. A group that does not
    split is named and left out of the rounds to come.
    """
    spark, path = messages.sparkSession, f"{checkpoint_dir(messages.sparkSession)}/staged/templates-{uuid.uuid4().hex}"
    counted = messages.groupBy(F.coalesce(column, F.lit("")).alias("message")).agg(F.count(F.lit(1)).alias("n"))
    split = F.split(F.regexp_replace("message", r"^\s+|\s+$", ""), r"\s+")
    words = F.when(F.col("message").rlike(r"\S"), split)
    groups = staged(counted.select("message", "n", words.alias("words"), F.size(words).cast("string").alias("path")), "groups")
    groups.filter("words IS NULL").select("message", F.lit("").alias("template"), "n").write.mode("append").parquet(path)
    groups = groups.filter("words IS NOT NULL")
    for round_ in range(rounds + 1):
        positions = staged(_positions(groups, most_values), "counted")
        splitting = (F.col("values") > 1) & (F.col("values") <= most_values)
        enough = F.col("values") * least_messages <= F.col("messages")
        best = F.min(F.struct("values", "pos"))["pos"].alias("pos")
        chosen = staged(positions.filter(splitting & enough & F.lit(round_ < rounds)).groupBy("path").agg(best), "splits")
        named = staged(_named(positions.join(chosen, "path", "left_anti")), "names")
        done = _met(groups, named, ["path"], "inner", "message").select("message", "template", "n")
        done.write.mode("append").parquet(path)
        if chosen.isEmpty():
            break
        met = _met(groups, chosen, ["path"], "inner", "message")
        longer = F.concat_ws("\n", "path", F.concat_ws("=", "pos", F.get("words", F.col("pos")))).alias("path")
        groups = staged(met.select("message", "n", "words", longer), "groups")
    return spark.read.schema("message STRING, template STRING, n BIGINT").parquet(path)


def failure_templates(items: DataFrame, **options: int) -> DataFrame:
    """(template, items, messages, named) of the failed items; `named` if any word of it is fixed."""
    failed = items.filter(F.col("status") == "failed")
    return summed(learned_templates(failed, **options))


def summed(found: DataFrame) -> DataFrame:
    """Templates with their rows and distinct messages."""
    fixed = F.filter(F.split("template", " "), lambda w: (w != WILDCARD) & (w != ""))
    return (
        found.groupBy("template")
        .agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("messages"))
        .withColumn("named", F.size(fixed) > 0)
    )

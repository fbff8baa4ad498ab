"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule votes for a text (1), against it (-1) or abstains (0) by one measure of the whole text. Nobody
tells how good the rules are: expectation-maximisation finds the accuracies under which the votes agree
best, and the posterior probability of a good text takes the place of having to pass every rule.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.llm.common import staged

WINDOW = 8  # words of a window that may repeat
FEWEST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
TOLERANCE = 1e-4  # expectation-maximisation ends when no probability of a vote moves by more
LEAST_ACCURACY = 0.8  # of a vote against a text
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = (
    "n_words word_chars n_symbols n_lines n_dup_lines n_closed_lines n_repeat_words n_distinct_words "
    "n_same_words n_upper n_marks"
).split()


def _chars(text: Column, chosen: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chosen, ""))).cast("bigint")


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The measures of every whole text beside the `keep` columns (default: all).

    Words are runs without white space (space, \\t to \\r). n_repeat_words counts the words in 8-word
    windows that are found twice or more in the text; windows are compared by 64-bit hashes of their
    words' hashes. n_dup_lines counts lines with a word that equal an earlier line. A null text counts as
    empty. Columns already named like a measure are replaced.
    """
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in MEASURES]
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(*kept, whole.alias("_text"))
    trimmed = F.btrim("_text", F.lit(SPACE))
    cut = base.select(
        *[c for c in base.columns if c != "_text"],
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, r"[ \t-\r]+"))
        .alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"),
        F.length(F.translate("_text", SPACE, "")).cast("bigint").alias("word_chars"),
        _chars(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _chars(F.col("_text"), UPPER).alias("n_upper"),
        _chars(F.col("_text"), MARKS).alias("n_marks"),
    )
    counted = cut.select(
        *[c for c in cut.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).rlike("[.!?\"'»”]$"))).cast("bigint").alias("n_closed_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windowed = counted
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words, each from two halves
        windowed = windowed.withColumn(
            "_windows",
            F.expr(
                "zip_with({0}, slice({0}, {1} + 1, size({0})), (a, b) -> xxhash64(a, b))".format(
                    "_hashes" if step == 1 else "_windows", step
                )
            ),
        )
    windowed = windowed.withColumn(
        "_windows", F.expr(f"slice(_windows, 1, greatest(cast(n_words as int) - {WINDOW - 1}, 0))")
    )
    ranked = windowed.withColumn(
        "_ranked",
        F.expr(
            """CASE WHEN size(array_distinct(_windows)) < size(_windows)
            THEN array_sort(transform(_windows, (x, i) -> struct(x AS x, i AS i))) END"""
        ),
    )
    starts = ranked.withColumn(
        "_starts",
        F.expr(
            """array_sort(transform(filter(transform(_ranked, (p, k) -> struct(p.i AS i,
                 coalesce(get(_ranked, k - 1).x = p.x, false)
                 OR coalesce(get(_ranked, k + 1).x = p.x, false) AS again)),
               p -> p.again), p -> p.i))"""
        ),
    )
    repeated = F.expr(
        f"""coalesce(aggregate(zip_with(_starts, slice(_starts, 2, size(_starts)),
              (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (t, x) -> t + x), 0L)"""
    )
    same = F.expr(
        """aggregate(zip_with(_hashes, slice(_hashes, 2, greatest(size(_hashes) - 1, 0)),
             (a, b) -> if(a <=> b, 1, 0)), 0L, (t, x) -> t + x)"""
    )
    return starts.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        "n_closed_lines",
        repeated.alias("n_repeat_words"),
        F.size(F.array_distinct("_hashes")).cast("bigint").alias("n_distinct_words"),
        same.alias("n_same_words"),
        "n_upper",
        "n_marks",
    )


@dataclass(frozen=True)
class Rule:
    """Votes against when `bad` holds, for when `good` holds, else abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "n_words BETWEEN 50 AND 100000"),
    Rule("word length", "word_chars < 2 * n_words OR word_chars > 14 * n_words",
         "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols < n_words"),
    Rule("marks", "10 * n_marks > word_chars", "20 * n_marks < word_chars"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_lines > 1 AND 20 * n_dup_lines <= n_lines"),
    Rule("repeated windows", "100 * n_repeat_words > 25 * n_words", "100 * n_repeat_words < 5 * n_words"),
    Rule("repeated words", "20 * n_same_words > n_words", "50 * n_same_words < n_words"),
    Rule("capitals", "5 * n_upper > word_chars", "10 * n_upper < word_chars"),
    Rule("vocabulary", "n_words >= 50 AND 5 * n_distinct_words < n_words AND n_words < 2000",
         "5 * n_distinct_words > 2 * n_words"),
    Rule("closed lines", "5 * n_closed_lines < n_lines", "2 * n_closed_lines >= n_lines"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """An array of -1, 0 and 1, one for each rule; texts without words get abstentions only."""
    return F.array(
        *[
            F.when(F.col("n_words") == 0, 0)
            .when(F.expr(r.bad), -1)
            .when(F.expr(r.good), 1)
            .otherwise(0)
            .cast("int")
            for r in rules
        ]
    )


@dataclass(frozen=True)
class LabelModel:
    """Per rule, how probable a vote against and a vote for are in bad and in good texts."""

    prior: float  # probability of a good text
    bad: tuple[tuple[float, float], ...]
    good: tuple[tuple[float, float], ...]

    def posterior(self, votes: str = "votes") -> Column:
        """Probability of a good text, given its votes and independent rules."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, (b, g) in enumerate(zip(self.bad, self.good)):
            vote = F.get(votes, F.lit(j))
            odds = odds + F.when(vote == -1, math.log(g[0] / b[0])).when(
                vote == 1, math.log(g[1] / b[1])
            ).otherwise(math.log((1 - g[0] - g[1]) / (1 - b[0] - b[1])))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def accuracies(self) -> list[tuple[float, float]]:
        """Per rule, how often its votes against and its votes for are right."""
        p = self.prior
        return [
            ((1 - p) * b[0] / ((1 - p) * b[0] + p * g[0]), p * g[1] / ((1 - p) * b[1] + p * g[1]))
            for b, g in zip(self.bad, self.good)
        ]


START = LabelModel(0.8, ((0.3, 0.4),), ((0.02, 0.7),))  # of every rule, with the weight of IMAGINED votes
IMAGINED = 10


def fit(patterns: DataFrame, n_rules: int, iterations: int | None = None) -> LabelModel:
    """Prior and accuracies by expectation-maximisation over vote patterns with their counts (votes, n).

    There are at most 3**rules patterns, whatever the number of texts. A vote against a text is taken to
    be right at least LEAST_ACCURACY of the time, so that a rule is never read as its opposite; the prior
    is held between 0.05 and 0.95. Without texts, the start values stay. It runs until no probability moves
    by more than TOLERANCE, or for the given number of rounds.
    """
    model = LabelModel(START.prior, START.bad * n_rules, START.good * n_rules)
    for _ in itertools.count() if iterations is None else range(iterations):
        n, good = F.col("n"), F.col("n") * F.col("q")
        sums = [F.sum(n).alias("all"), F.sum(good).alias("good")]
        for j in range(n_rules):
            for name, value in (("against", -1), ("for", 1)):
                cast = F.get("votes", F.lit(j)) == value
                sums += [
                    F.sum(F.when(cast, n).otherwise(0)).alias(f"{name}{j}"),
                    F.sum(F.when(cast, good).otherwise(0.0)).alias(f"{name}{j}_good"),
                ]
        row = patterns.withColumn("q", model.posterior()).agg(*sums).first()
        if not row["all"]:
            return model
        better = _maximised(row.asDict(), n_rules)
        moved = max(abs(x - y) for x, y in zip(sum(better.bad, ()), sum(model.bad, ())))
        model = better
        if moved < TOLERANCE:
            break
    return model


def _maximised(sums: dict, n_rules: int) -> LabelModel:
    prior = min(0.95, max(0.05, sums["good"] / sums["all"]))
    bad, good = [], []
    for j in range(n_rules):
        share = {}
        for kind, total, start in (
            ("good", sums["good"], START.good[0]),
            ("bad", sums["all"] - sums["good"], START.bad[0]),
        ):
            counts = []
            for name in ("against", "for"):
                in_good = sums[f"{name}{j}_good"]
                counts.append(in_good if kind == "good" else sums[f"{name}{j}"] - in_good)
            share[kind] = [(c + IMAGINED * s) / (total + IMAGINED) for c, s in zip(counts, start)]
        most = (1 - LEAST_ACCURACY) / LEAST_ACCURACY * (1 - prior) * share["bad"][0] / prior
        against, pro = share["good"]
        if against > most:
            against, pro = most, pro * (1 - most) / (1 - against)
        bad.append(tuple(share["bad"]))
        good.append((against, pro))
    return LabelModel(prior, tuple(bad), tuple(good))


def judge(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    rules: tuple[Rule, ...] = RULES,
    iterations: int | None = None,
) -> DataFrame:
    """The `keep` columns (default: all but the text), the measures, votes, posterior, base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 in 100 words in repeated windows. kept: not
    base_failed, and the posterior probability of a good text is at least one half. Texts are read once;
    their measures are staged, the votes counted by pattern, and both are narrow.

    Null and empty texts have no words and fail. Repeated rows get equal verdicts. Columns that clash
    with a result are replaced; an empty table gives an empty result.
    """
    made = {*MEASURES, "votes", "posterior", "base_failed", "kept"}
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    if keep is None:
        columns = [c for c in columns if c != text]
    voted = staged(measures(docs, text, columns).withColumn("votes", votes(rules)), "votes")
    patterns = staged(
        voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns"
    )
    model = fit(patterns, len(rules), iterations)
    failed = (F.col("n_words") < FEWEST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return (
        voted.withColumn("posterior", model.posterior())
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= 0.5))
    )

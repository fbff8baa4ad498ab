"""Rules, decontamination, languages and the classifier on odd tables and against plain versions."""

import random

import pytest

from inkferry.llm import compression, languages, rules
from inkferry.llm import decontaminate as d
from tests.llm import plain
from tests.llm.conftest import by_row, prose

COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()


def test_measures_and_base_rule(odd_docs, odd_rows):
    judged = rules.judge(odd_docs, keep=["doc_id", "key"])
    expected = []
    for i, text in odd_rows:
        m = plain.measures(text)
        expected.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert by_row(judged, "doc_id", *COUNTS, "base_failed") == sorted(expected, key=repr)
    assert not judged.filter("base_failed AND kept").count()
    assert "key" in judged.columns


def test_rules_on_no_rows(no_docs):
    assert rules.judge(no_docs).count() == 0


def plain_fit(patterns, n_rules, rounds):
    """The same expectation-maximisation over a dict of vote tuples and counts."""
    import math

    prior, bad, good = 0.8, [(0.3, 0.4)] * n_rules, [(0.02, 0.7)] * n_rules

    def posterior(votes):
        odds = math.log(prior / (1 - prior))
        for v, b, g in zip(votes, bad, good):
            pick = {-1: lambda p: p[0], 1: lambda p: p[1], 0: lambda p: 1 - p[0] - p[1]}[v]
            odds += math.log(pick(g) / pick(b))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        q = {v: posterior(v) for v in patterns}
        total = sum(patterns.values())
        weight = sum(n * q[v] for v, n in patterns.items())
        prior = min(0.95, max(0.05, weight / total))
        for j in range(n_rules):
            new = []
            for in_class, size, start in (
                (lambda v: 1 - q[v], total - weight, (0.3, 0.4)),
                (lambda v: q[v], weight, (0.02, 0.7)),
            ):
                new.append(
                    tuple(
                        (sum(n * in_class(v) for v, n in patterns.items() if v[j] == s) + 10 * p) / (size + 10)
                        for s, p in zip((-1, 1), start)
                    )
                )
            most = 0.25 * (1 - prior) * new[0][0] / prior
            if new[1][0] > most:
                new[1] = (most, new[1][1] * (1 - most) / (1 - new[1][0]))
            bad[j], good[j] = new
    return posterior


def test_label_model_equals_plain_version(spark):
    rng = random.Random(1)
    patterns = {}
    for _ in range(800):
        good = rng.random() < 0.7
        votes = tuple(rng.choices((-1, 0, 1), (0.05, 0.3, 0.65) if good else (0.6, 0.3, 0.1))[0] for _ in range(4))
        patterns[votes] = patterns.get(votes, 0) + 1
    table = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n bigint")
    model = rules.fit(table, 4, iterations=5)
    posterior = plain_fit(patterns, 4, 5)
    for row in table.select("votes", model.posterior().alias("q")).collect():
        assert row.q == pytest.approx(posterior(tuple(row.votes)), abs=1e-9)
    assert all(a >= rules.LEAST_ACCURACY - 1e-9 for a, _ in model.accuracies())


@pytest.fixture(scope="module")
def items(odd_rows):
    texts = dict(odd_rows)
    passage = texts[12].split()
    long = [w for i, t in odd_rows if i and i >= 100 for w in (t or "").split()][:2100]
    return [
        (1, " ".join(passage[10:40]).upper()),
        (2, "One!"),
        (3, None),
        (4, "..."),
        (5, " ".join(passage[5:12])),
        (1, "日本語 ÉÉß"),
        (None, " ".join(passage[50:63])),
        (6, " ".join(long)),
    ]


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 4000])
def test_contamination(spark, odd_docs, odd_rows, items, automaton_bytes):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.decontaminate(odd_docs, bench, keep=["doc_id", "text", "key"], automaton_bytes=automaton_bytes)
    got = []
    for row in found.collect():
        spans = row.contamination.spans
        got.append((row.doc_id, row.contamination.n_words, row.contamination.n_hit, row.contamination.items))
        for s in spans:
            piece = plain.NORMAL.findall(row.text[s.char_start : s.char_end].translate(plain.LOWER))
            assert len(piece) == s.word_end - s.word_start
            assert piece == plain.NORMAL.findall(row.text.translate(plain.LOWER))[s.word_start : s.word_end]
    expected = []
    for i, text in odd_rows:
        n, hit, names = plain.contamination(text, items)
        expected.append((i, n, len(hit), names))
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_contamination_without_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.decontaminate(odd_docs, none).filter("contamination.n_hit > 0").count() == 0
    some = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert d.decontaminate(no_docs, some).count() == 0


def test_many_parts_scan_the_texts_once(odd_docs, spark, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = d.decontaminate(odd_docs, bench, keep=["doc_id"], automaton_bytes=200)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Union" not in plan


ALPHABETS = {"aa": "aeiou lmn", "bb": "zxkvy wqp", "cc": "éàçs trd"}


def babble(rng, lang, n):
    return "".join(rng.choice(ALPHABETS[lang]) for _ in range(n))


def test_languages_and_mixtures(spark, odd_docs, no_docs):
    rng = random.Random(5)
    train = [(babble(rng, lang, 300), lang) for lang in ALPHABETS for _ in range(30)] + [(None, "dd"), ("xx", None)]
    model = languages.train(spark.createDataFrame(train, "text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    texts = [(babble(rng, "bb", 200), "bb"), (babble(rng, "cc", 2000) + babble(rng, "aa", 900), "cc")]
    texts += [(None, "und"), ("", "und"), ("123 !?", "und"), ("é", "aa")]
    rows = spark.createDataFrame([(t, i, "old") for i, (t, _) in enumerate(texts)], "text string, n int, score string")
    found = languages.identify(rows, model).orderBy("n").collect()
    assert [r.lang_pred for r in found] == [lang for _, lang in texts]
    assert all(0 <= r.score <= 1 for r in found)
    assert [s.lang for s in found[1].languages] == ["cc", "aa"]
    bytes_of = [len(texts[1][0][:2000].encode()), 900]
    assert found[1].languages[1].share == pytest.approx(900 / sum(bytes_of), abs=0.05)
    assert languages.identify(odd_docs, model).count() == odd_docs.count()
    assert languages.identify(no_docs, model).count() == 0
    nothing = languages.train(no_docs.selectExpr("text", "key AS lang"))
    assert {r.lang_pred for r in languages.identify(odd_docs, nothing).collect()} == {"und"}


def test_mixture_of_six_languages(spark):
    rng = random.Random(8)
    letters = dict(zip("abcdef", ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]))
    text = {lang: "".join(rng.choice(own + " ") for _ in range(600)) for lang, own in letters.items()}
    model = languages.train(spark.createDataFrame([(t, lang) for lang, t in text.items()], "text string, lang string"))
    rows = spark.createDataFrame([(0, "".join(text.values())), (1, text["b"])], "n int, text string")
    found = languages.identify(rows, model).orderBy("n").collect()
    assert sorted(s.lang for s in found[0].languages) == list("abcdef")
    assert all(s.share == pytest.approx(1 / 6, abs=0.02) for s in found[0].languages)
    assert found[0].score == pytest.approx(1 / 6, abs=0.02)
    assert [s.lang for s in found[1].languages] == ["b"]


def test_classifier_tells_kinds_apart(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng, rng.randrange(20, 200))
        rows.append((i, " ".join(w + rng.choice(["###", "$$$"]) for w in text.split()) if bad else text))
        labels.append((i, 0 if bad else 1))
    labels += [(3, 0), (None, 1), (7, None), (9, 5)]  # contradictory, null and unknown labels
    docs = spark.createDataFrame([*rows, rows[1], rows[1]], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = compression.train(docs, compression.training_rows(marks))
    truth = dict(labels[:400])
    scored = compression.score(docs, model, keep=["doc_id"]).collect()
    held = [r for r in scored if r.doc_id % 5 == 0]
    right = sum((r.quality_score >= compression.THRESHOLD) == bool(truth[r.doc_id]) for r in held)
    assert right >= 0.95 * len(held)
    odd = compression.score(odd_docs, model, out="key").collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.key <= 1 for r in odd)
    assert compression.score(no_docs, model).count() == 0
    one_class = compression.train(docs, marks.filter("quality = 1"))
    assert all(r.quality_score > 0.9 for r in compression.score(docs, one_class).collect())
    empty = compression.train(docs, marks.filter("false"))
    assert {r.quality_score for r in compression.score(docs, empty).collect()} == {0.5}


def plain_shares(rows, counts, rounds=4000):
    """Expectation-maximisation in plain Python, long after it has converged."""
    shares = [1 / len(rows)] * len(rows)
    total = sum(counts)
    for _ in range(rounds):
        mixed = [sum(s * row[g] for s, row in zip(shares, rows)) for g in range(len(counts))]
        shares = [s * sum(n * row[g] / mixed[g] for g, n in enumerate(counts)) / total for s, row in zip(shares, rows)]
    return shares


def test_mixture_equals_plain_expectation_maximisation():
    import numpy as np

    rng = random.Random(21)
    for _ in range(25):
        k, grams = rng.randrange(2, 5), rng.randrange(3, 9)
        rows = [[rng.random() + 0.02 for _ in range(grams)] for _ in range(k)]
        rows = [[x / sum(row) for x in row] for row in rows]
        counts = [rng.randrange(1, 60) for _ in range(grams)]
        shares, fit, most = languages.mixture(np.array(rows), np.array(counts, float))
        plain_fit_ = lambda s: sum(
            n * np.log(sum(x * row[g] for x, row in zip(s, rows))) for g, n in enumerate(counts)
        )
        best = plain_fit_(plain_shares(rows, counts))
        assert fit <= best + 1e-9 and best <= most + 1e-9  # the bound holds
        assert best - fit < 0.01 * sum(counts) / 100 + 0.05


def test_language_set_has_the_best_penalised_likelihood():
    """Stopping early by the bound gives what judging every nested set gives."""
    import numpy as np

    rng = random.Random(22)
    for _ in range(60):
        k, grams = rng.randrange(1, 6), rng.randrange(3, 30)
        rows = np.array([[rng.random() ** 4 + 1e-3 for _ in range(grams)] for _ in range(k)])
        rows /= rows.sum(1, keepdims=True)
        truth = rng.sample(range(k), rng.randrange(1, k + 1))
        counts = np.array([rng.randrange(1, 4) for _ in range(grams)], float) + np.round(200 * rows[truth].mean(0))
        order = np.argsort(-languages.mixture(rows, counts)[0], kind="stable")
        values = []
        for size in range(1, k + 1):
            fit = languages.mixture(rows[order[:size]], counts)[1]
            values.append(fit / languages.GRAM - 0.5 * np.log(counts.sum() + 1) * (size - 1))
        found = languages.languages_of(rows, counts)
        assert sorted(i for i, _ in found) == sorted(order[: 1 + int(np.argmax(values))].tolist())
        assert sum(s for _, s in found) == pytest.approx(1)


def test_tied_shares_take_the_first_language():
    import numpy as np

    rows = np.array([[0.5, 0.5], [0.5, 0.5]])
    assert languages.languages_of(rows, np.array([3.0, 3.0]))[0][0] == 0


def plain_outline(text):
    out, seen = [], set()
    before = None
    for line in text.split("\n"):
        if not line:
            continue
        if line in seen:
            out.append("~")
            continue
        seen.add(line)
        marks = []
        for word in line.split():
            shape = "".join("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in word)
            marks.append("=" if word == before else shape)
            before = word
        out.append(" ".join(marks))
    return "\n".join(out).encode()


def test_size_difference_equals_plain_sizes():
    import zstandard

    rng = random.Random(23)
    good, bad = (" ".join(rng.choice(w) for _ in range(3000)).encode() for w in (["aaa", "aaaa.", "Aa"], ["000", "###", "=!"]))
    measure = compression.SizeDifference(good, bad)

    def size(dictionary, text):
        params = zstandard.ZstdCompressionParameters.from_level(
            3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=params)
        data = plain_outline(text)
        return sum(len(tool.compress(data[i : i + 128])) for i in range(0, len(data), 128))

    for _ in range(60):
        text = "\n".join(prose(rng, rng.randrange(9)) + rng.choice(["", " ###", " 12 12", "!"]) for _ in range(rng.randrange(8)))
        sizes = size(good, text), size(bad, text)
        assert measure.of(text.encode()) == (sizes[1] - sizes[0]) / max(*sizes, 1)


def test_curve_has_the_least_loss():
    import numpy as np

    rng = np.random.default_rng(24)
    x = rng.normal(0, 0.2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(9 * x + 0.7)))).astype(float)
    slope, intercept = compression._fit_logistic(x, y)

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * x + b)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    least = min(loss(a, b) for a in np.linspace(0, 20, 81) for b in np.linspace(-2, 3, 51))
    assert loss(slope, intercept) <= least + 1e-3

"""Conversation repair against a plain search over edits, whole and in pieces."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkferry.llm import auction, conversations
from tests.llm import plain
from tests.llm.conftest import by_row

COLUMNS = ["conv_id", *conversations.COUNTS, "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece string, cost int, conv string"


def some_codes(rng, n):
    return [rng.choice([0, 1, 1, 1, 2, 2, 2, 3]) + rng.choice([0] * 7 + [4, 4, 8]) for _ in range(n)]


def test_auction_equals_plain_search():
    rng = random.Random(1)
    for _ in range(1500):
        codes = some_codes(rng, rng.randrange(9) if rng.random() < 0.9 else 60)
        assert auction.whole(codes) == plain.cheapest_edits(codes), codes


def test_parts_join_to_the_whole():
    rng = random.Random(2)
    for _ in range(400):
        codes = some_codes(rng, rng.randrange(1, 30))
        cuts = sorted({0, len(codes), *(rng.randrange(len(codes)) for _ in range(3))})
        parts = [codes[a:z] for a, z in zip(cuts, cuts[1:])]
        states, cost = auction.joined([auction.part(p) for p in parts])
        letters = "".join(auction.part_letters(p, a, z) for p, (a, z) in zip(parts, states))
        letters += auction.whole([], states[-1][1])[0]
        assert (letters, cost) == plain.cheapest_edits(codes), (codes, cuts)


def test_converged_prices_are_feasible():
    """No price is above an arc's cost and the price behind it; exact at the origin."""
    codes = some_codes(random.Random(3), 50) + [auction.END]
    prices = auction.prices(codes, [0] * 4)
    for layer, code in enumerate(codes):
        for state in range(4):
            for _, cost, step, to in auction.ARCS[code][state]:
                assert prices[4 * layer + state] <= cost + prices[4 * (layer + step) + to]


def rows_of(rng, convs):
    texts = ["yes.", "no", "why?", "  ", "", "a long answer! ", "é日本。", "Stop.\n", None]
    rows = []
    for conv, n in convs:
        for _ in range(n):
            turn = rng.choice([None, *range(max(1, n))])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "unknown"])
            rows.append((conv, turn, role, rng.choice(texts), "x", 1, None))
    return rows


def expected_of(rows):
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append((row[1], row[2] or (" " if row[2] is None else ""), row[3]))
    out = []
    for conv, turns in by_conv.items():
        turns = [(t, r, " " if x is None else x) for t, r, x in turns]
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        turns.sort(key=lambda t: (t[0] is not None, t[0], t[1], digest(t[2])))
        out.append((conv, *plain.conversation(turns)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece_turns", [4096, 3])
def test_repair_equals_plain_version(spark, piece_turns):
    rng = random.Random(piece_turns)
    convs = [(i, rng.randrange(1, 9)) for i in range(60)] + [(None, 7), (100, 150), (101, 40)]
    rows = rows_of(rng, convs) + [(102, 1, "user", "same.", "x", 1, None)] * 50
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    pieces = conversations.repair(turns, piece_turns=piece_turns)
    if piece_turns < 10:
        assert pieces.filter("conv_id = 100").count() >= 150 / piece_turns
    assert by_row(conversations.summaries(turns, pieces), *COLUMNS) == expected_of(rows)


def test_pieces_carry_the_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello"), (1, 2, "assistant", "Bye.")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = sorted(conversations.repair(turns).collect(), key=lambda r: r.piece)
    assert "".join(r.audit for r in found) == "KDK" and found[0].cost == 4
    assert "\n".join(r.repaired for r in found if r.n_kept) == "user:Hi.\nassistant:Bye."
    assert sum(r.n_kept for r in found) == 2 and {r.conv_id for r in found} == {1}


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    pieces = conversations.repair(none)
    assert pieces.count() == 0 and conversations.summaries(none, pieces).count() == 0


def test_conversation_lost_to_damage(spark):
    turns = spark.createDataFrame([(7, 1, "user", "Hi."), (None, None, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    pieces = conversations.repair(turns.filter("conv_id IS NULL"))
    found = {r.conv_id: r for r in conversations.summaries(turns, pieces).collect()}
    assert (found[7].audit, found[7].cost, found[7].repaired_sha256) == ("", 0, plain.sha256(""))
    assert (found[None].audit, found[None].cost) == ("KI", 3)


def test_damage(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t in (*range(5), None) for r, x in [("assistant", "Ja. Wo? Hm!"), (None, None)]]
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        if kind == 1:
            x = ""
        elif kind == 2:
            x = "".join(ch for ch in x if ch not in ".!?")
        elif kind == 4:
            r = "user"
        out += [(c, t, r, x)] * (kind != 0) * (1 + (kind == 3))
    made = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert by_row(made, "conv_id", "turn", "role", "text") == sorted(out, key=repr)
    assert made.filter(F.col("role").isNull()).count() == 0

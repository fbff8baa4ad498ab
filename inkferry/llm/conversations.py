"""Repairing the turn structure of conversations at least cost, however long one conversation is.

Turns are sorted by range, so a long conversation lies in several partitions, and one pass cuts the
sorted rows into pieces of bounded size. A conversation that lies whole in one piece, as nearly all do,
is repaired there (see `auction`). The pieces of the others meet as tables of least costs between their
first and last states, 32 small numbers a piece: these choose the states between pieces, and each piece
is then repaired between its two states by itself. No task ever holds the turns of a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkferry.llm import auction
from inkferry.llm.common import partitions_for, ready, staged, text_bytes

PIECE_TURNS = 4096
PIECE_CHARS = 4 << 20
PARTITION_BYTES = 32 << 20
FLUSH_CHARS = 8 << 20
SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
NOT_BLANK = r"[^\x20\x09-\x0D]"
LEGAL = {"su", "ua", "au"}

FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
COUNTS = FACTS.replace(" bigint", "").split(", ")
TURNS = "array<struct<turn: bigint, role: string, text: string>>"
CUT = f"piece bigint, whole boolean, {FACTS}, audit string, repaired string, n_kept bigint, turns {TURNS}"
PART = (
    "piece bigint, costs array<bigint>, ranks array<int>, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, first_initial string, last_initial string, n_turns bigint, low bigint, high bigint"
)
CHOSEN = f"piece bigint, first_state int, last_state int, tail string, {FACTS}"
PIECE = f"piece bigint, whole boolean, {FACTS}, audit string, repaired string, n_kept bigint"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

Turn = tuple[int | None, str, str]


def damaged(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Break turns in ways chosen by crc32(`conv:turn`) % 20, for measuring the repair.

    0 drops the turn, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's.
    Nulls count as one space, but a null conversation or turn stays null.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in (conv, turn)])
    rows = turns.select(
        F.col(conv),
        F.col(turn),
        F.coalesce(F.col(role), space).alias(role),
        F.coalesce(F.col(text), space).alias(text),
        (F.crc32(name.cast("binary")) % 20).alias("_kind"),
    )
    kind, body = F.col("_kind"), F.col(text)
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(body, STOPS, "")).otherwise(body)
    return rows.filter(kind != 0).select(
        F.col(conv),
        F.col(turn),
        F.when(kind == 4, "user").otherwise(F.col(role)).alias(role),
        changed.alias(text),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _faults(turns: list[Turn], first: set[int] | None = None) -> tuple[list[int], list[int]]:
    """Turn codes, and how many turns are blank, repeated and cut off, and adjacent roles not allowed.

    Which turns are the first of their role and text is found here or, for a piece, given.
    """
    codes, counts, seen, before = [], [0, 0, 0, 0], set(), None
    for at, (_, role, text) in enumerate(turns):
        body = text.rstrip(SPACES)
        blank = not body
        again = not blank and (at not in first if first is not None else (role, text) in seen)
        seen.add((role, text))
        cut_off = not blank and not again and body[-1] not in STOPS
        codes.append(auction.turn_code(role, blank or again, cut_off))
        if before is not None:
            counts[3] += before + role[:1] not in LEGAL
        before = role[:1]
        counts[0] += blank
        counts[1] += again
        counts[2] += cut_off
    return codes, counts


def _distinct_turns(turns: list[Turn]) -> tuple[int, int | None, int | None]:
    """Distinct turn numbers, the least and the greatest, of turns in their order, nulls first."""
    known = [t for t, _, _ in turns if t is not None]
    if not known:
        return 0, None, None
    return 1 + sum(a != b for a, b in zip(known, known[1:])), known[0], known[-1]


def _gaps(distinct: int, low: int | None, high: int | None) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _repaired(turns: list[Turn], letters: str, state: int) -> dict:
    lines = auction.edited([(role, text) for _, role, text in turns], letters, state)
    return {"audit": letters, "repaired": "\n".join(lines), "n_kept": len(lines)}


def _whole(turns: list[Turn]) -> dict:
    codes, (blank, again, cut_off, illegal) = _faults(turns)
    letters, cost = auction.whole(codes)
    return {
        "whole": True,
        "gaps": _gaps(*_distinct_turns(turns)),
        "blank": blank,
        "duplicate": again,
        "truncated": cut_off,
        "illegal": illegal,
        "cost": cost,
        **_repaired(turns, letters, auction.NOTHING),
    }


def _batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their size, in batches of bounded size."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 100
        if size >= FLUSH_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cutter(schema: pa.Schema, piece_turns: int, piece_chars: int) -> Callable:
    """Cut a sorted partition into pieces; repair what is whole, hand on the turns of what is not."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conversation, turns, starts a conversation, is cut) piece by piece."""
        conv, turns, size, starts = None, [], 0, True
        for batch in batches:
            for key, turn, role, text in zip(*[column.to_pylist() for column in batch.columns]):
                if turns and (key != conv or len(turns) >= piece_turns or size >= piece_chars):
                    yield conv, turns, starts, key == conv
                    starts = key != conv
                    turns, size = [], 0
                conv = key
                turns.append((turn, role, text))
                size += len(role) + len(text)
        if turns:
            yield conv, turns, starts, True  # the conversation may go on in the next partition

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        number = TaskContext.get().partitionId() << 33
        for n, (conv, turns, starts, is_cut) in enumerate(pieces(batches)):
            row = {"conv": conv, "piece": number + n}
            if starts and not is_cut and n:  # the first one may have begun in the partition before
                row |= _whole(turns)
            else:
                row |= {"whole": False, "turns": [dict(zip(("turn", "role", "text"), t)) for t in turns]}
            yield sum(len(role) + len(text) for _, role, text in turns), row

    return lambda batches: _batches(rows(batches), schema)


def _turns_of(row: dict) -> list[Turn]:
    return [(t["turn"], t["role"], t["text"]) for t in row["turns"]]


def _per_row(run: Callable[[dict], dict], schema: pa.Schema) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                yield sum(len(t["role"]) + len(t["text"]) for t in row["turns"]), run(row)

    return lambda batches: _batches(rows(batches), schema)


def _part(row: dict) -> dict:
    """What the other pieces of a conversation need to know about one."""
    turns = _turns_of(row)
    codes, (blank, again, cut_off, illegal) = _faults(turns, set(row["firsts"] or ()))
    costs, ranks = auction.part(codes)
    n_turns, low, high = _distinct_turns(turns)
    return {
        "conv": row["conv"],
        "piece": row["piece"],
        "costs": costs,
        "ranks": ranks,
        "blank": blank,
        "duplicate": again,
        "truncated": cut_off,
        "illegal": illegal,
        "first_initial": turns[0][1][:1],
        "last_initial": turns[-1][1][:1],
        "n_turns": n_turns,
        "low": low,
        "high": high,
    }


def _repair_part(row: dict) -> dict:
    turns = _turns_of(row)
    codes, _ = _faults(turns, set(row["firsts"] or ()))
    letters = auction.part_letters(codes, row["first_state"], row["last_state"]) + row["tail"]
    kept = ("conv", "piece", *COUNTS)
    return {**{c: row[c] for c in kept}, "whole": False, **_repaired(turns, letters, row["first_state"])}


def _choose(schema: pa.Schema) -> Callable:
    """The states between the pieces of one conversation, and its facts, with its first piece."""

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda p: p["piece"])
        states, cost = auction.joined([(p["costs"], p["ranks"]) for p in parts])
        facts = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
        known = [p for p in parts if p["low"] is not None]
        distinct = sum(p["n_turns"] for p in known)
        for a, b in zip(known, known[1:]):
            distinct -= a["high"] == b["low"]
        for a, b in zip(parts, parts[1:]):
            facts["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL
        facts["gaps"] = _gaps(distinct, known[0]["low"], known[-1]["high"]) if known else 0
        facts["cost"] = cost
        rows = [
            {"conv": p["conv"], "piece": p["piece"], "first_state": a, "last_state": z, "tail": ""}
            for p, (a, z) in zip(parts, states)
        ]
        rows[0] |= facts
        rows[-1]["tail"] = auction.whole([], states[-1][1])[0]
        return pa.Table.from_pylist(rows, schema)

    return run


def _shape(conv: T.StructField, columns: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("conv", conv.dataType, True), *T._parse_datatype_string(columns).fields])
    return schema, to_arrow_schema(schema)


def repair(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    piece_turns: int = PIECE_TURNS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Edit each conversation at least cost until its roles read (system) user assistant user assistant ...

    Turns are taken by number, nulls first, equal numbers by role and then by the sha256 of their text,
    so equal turns are neighbours. The first fault of a turn counts: blank (white space only), duplicate
    (role and text seen before), truncated (no full stop at the end). Keep costs 0, Rerole (to user or
    assistant) 3, Delete 4, Insert (an empty user or assistant turn) 3; blank and duplicate turns must go,
    and a truncated one that stays costs 3 more. Of equally cheap edits the ASCII-least letters are taken.

    One row per piece of a conversation (one piece for nearly all): the conversation, `piece` (they rise
    along it), `whole` (it is the only piece); gaps, blank, duplicate, truncated, illegal and cost of the
    conversation, on its first piece; `audit`, the edits' letters; `repaired`, `role:text` of the `n_kept`
    repaired turns, a line each.

    A null conversation is one of its own; a null role or text counts as one space; an empty role has no
    initial. Repeated rows are duplicates. A conversation without rows is not in the result, an empty
    table gives an empty one. Other columns are ignored. The sorted pieces are staged.
    """
    spark = ready(turns.sparkSession)
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
    )
    n = partitions_for(spark, text_bytes(rows, "text"), PARTITION_BYTES)
    order = ["conv", "turn", "role", "_digest", "_row"]
    ranged = (
        rows.withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
        .withColumn("_row", F.monotonically_increasing_id())  # splits even a run of equal rows
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("conv", "turn", "role", "text")
    )
    key = rows.schema["conv"]
    shape, arrow = _shape(key, CUT)
    cut = staged(ranged.mapInArrow(_cutter(arrow, piece_turns, piece_chars), shape), "turns")
    names = [f.name for f in _shape(key, PIECE)[0]]
    done = cut.filter("whole").select(*names)
    joined = _joined(cut.filter("NOT whole").select("conv", "piece", "turns"), key).select(*names)
    return done.unionByName(joined).withColumnRenamed("conv", conv)


def _joined(open_pieces: DataFrame, key: T.StructField) -> DataFrame:
    """Repair the conversations that lie in several pieces, or might."""
    each = open_pieces.select("conv", "piece", F.posexplode("turns").alias("at", "t"))
    digest = F.sha2(F.col("t.text").cast("binary"), 256)
    firsts = (
        each.filter(F.col("t.text").rlike(NOT_BLANK))
        .groupBy("conv", "t.role", digest)
        .agg(F.min(F.struct("piece", "at")).alias("first"))
        .groupBy("first.piece")
        .agg(F.collect_list("first.at").alias("firsts"))  # at most a piece's turns
    )
    known = staged(open_pieces.join(firsts, "piece", "left"), "open-turns")
    shape, arrow = _shape(key, PART)
    parts = staged(known.mapInArrow(_per_row(_part, arrow), shape), "parts")
    shape, arrow = _shape(key, CHOSEN)
    # a conversation's audit is one string of less than 2**31 letters, so it has at most 2**31 / 4096 pieces
    chosen = parts.groupBy("conv").applyInArrow(_choose(arrow), shape)
    shape, arrow = _shape(key, PIECE)
    return known.join(chosen.drop("conv"), "piece").mapInArrow(_per_row(_repair_part, arrow), shape)


def _digests(schema: pa.Schema) -> Callable:
    """One row per conversation from its pieces in their order, hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, seal, any_line = None, [], None, False

        def finished() -> pa.RecordBatch:
            row = current | {"audit": "".join(audit), "repaired_sha256": seal.hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cost"] is not None:  # the first piece of a conversation
                    if current is not None:
                        yield finished()
                    current = {c: row[c] for c in ("conv", *COUNTS)}
                    audit, seal, any_line = [], hashlib.sha256(), False
                audit.append(row["audit"])
                if row["n_kept"]:
                    seal.update((b"\n" if any_line else b"") + row["repaired"].encode())
                    any_line = True
        if current is not None:
            yield finished()

    return run


def summaries(turns: DataFrame, pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of `turns`: the facts, the whole audit, and the sha256 of the repaired text.

    Conversations without pieces have zeros, an empty audit and the hash of an empty text.
    """
    key = pieces.schema[conv]
    columns = f"{FACTS}, audit string, repaired_sha256 string"
    shape, arrow = _shape(key, columns)
    named = pieces.withColumnRenamed(conv, "conv")
    sealed: Column = F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256")
    alone = named.filter("whole").select("conv", *COUNTS, "audit", sealed)
    several = (
        named.filter("NOT whole")
        .repartition("conv")
        .sortWithinPartitions("conv", "piece")
        .mapInArrow(_digests(arrow), shape)
    )
    found = alone.unionByName(several)
    every = turns.select(F.col(conv).alias("_conv")).distinct()
    zero = F.lit(0).cast("bigint")
    return every.join(found, F.col("_conv").eqNullSafe(F.col("conv")), "left").select(
        F.col("_conv").alias(conv),
        *[F.coalesce(F.col(c), zero).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )

"""Near duplicates by word shingles: a multi-index Hamming join of b-bit MinHash signatures.

A signature's slots are cut into chunks. Two signatures that differ in at most 2 * CHUNKS - 1 slots differ
in at most one slot of some chunk (pigeonhole), so each document enters, for every chunk, one bucket per
slot that is allowed to be wrong: every pair that differs in at most 23 of the 72 slots meets in a
bucket. For independent slots, about 0.5% of the pairs right at a similarity of 0.80 differ in more, and
2.6e-6 of them meet in no bucket. All pairs that meet are judged exactly: first by 1024-bit maps of the
sets, of which each bit that only one map has is an element that only one set has, then by the sets.

Equal sets are folded into their smallest id first. A bucket's members are compared with its smallest
id, not with each other, which settles nearly all groups in a number of pairs linear in the rows. Only
buckets whose members then still belong to several components need more. Their members meet again in
rare shingles: in a common order of shingles, rare ones first, two sets that are similar enough share one
so early that enough can follow it in both. Sizes and places are compared before documents are, so pages
of one template, which share frequent shingles late in that order, do not meet unless they can be linked.
A few documents of each shingle are paired with the others; families that are still not connected are
compared block against block, inside tasks that return nothing but links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.llm import scan
from inkferry.llm.common import partitions_for, ready, staged, staged_rows
from inkferry.operators.components import components

SHINGLE_WORDS = 5
SIMILARITY = 80  # percent of the union
CHUNKS = 12
CHUNK_SLOTS = 6
SLOTS = CHUNKS * CHUNK_SLOTS  # 8-bit slots of a signature
MAP_BITS = 1024  # of a set's map
SKETCH_CELLS = 1 << 20  # of the count sketch that orders shingles by how rare they are
SKETCH_ROWS = 256  # rows that it travels in
CENTERS = 8  # documents of a shingle that all others of it are compared with
BLOCK_DOCS = 256  # of a family, compared in one task
KEY_BYTES = 40  # of a bucket's entry in a shuffle, about
PARTITION_BYTES = 64 << 20

_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: scan.Block, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle."""
    found = scan.words(block, scan.is_space())
    hashes = scan.Hashes(scan.word_hashes(block, found, lower=True))
    sets = []
    for low, high in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if high == low:
            sets.append(np.zeros(0, np.uint64))
            continue
        starts = np.arange(low, max(low + 1, high - size + 1))
        sets.append(np.unique(hashes.windows(starts, np.minimum(starts + size, high))))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS bytes for each non-empty set: the low bits of the least hash per function."""
    if not sets:
        return np.zeros((0, SLOTS), np.uint8)
    values = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), SLOTS), np.uint8)
    for slot, seed in enumerate(_SEEDS):
        least = np.minimum.reduceat(values * seed, starts)
        out[:, slot] = scan.mixed(least) >> np.uint64(56)
    return out


def set_maps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits for each set: the bits that its hashes pick."""
    flags = np.zeros((len(sets), MAP_BITS), bool)
    if sets:
        flags[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) >> np.uint64(54)] = True
    return np.packbits(flags, axis=1)


def _sketcher(key: str, text: str, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in scan.blocks(batch.column(text)):
                sets = shingle_sets(block, size)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = iter(np.concatenate([signatures([sets[i] for i in full]), set_maps([sets[i] for i in full])], 1))
                marks = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).slice(block.first, len(block)).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([m and m[:SLOTS] for m in marks], pa.binary()),
                        pa.array([m and m[SLOTS:] for m in marks], pa.binary()),
                    ],
                    names=["id", "n_shingles", "set_id", "signature", "map"],
                )

    return run


def _set_maker(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in scan.blocks(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(block, size)]
                ids = batch.column("id").slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], names=["id", "set"])

    return run


def _bytes_table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for each chunk and each of its slots that may be wrong: the other slots, exactly."""
    for batch in batches:
        if not len(batch):
            continue
        marks = _bytes_table(batch.column("signature")).astype(np.int64)
        keys = []
        for chunk in range(CHUNKS):
            slots = range(chunk * CHUNK_SLOTS, (chunk + 1) * CHUNK_SLOTS)
            for wrong in slots:
                key = np.zeros(len(marks), np.int64)
                for slot in slots:
                    if slot != wrong:
                        key = key << 8 | marks[:, slot]
                keys.append(key << 7 | wrong)
        ids = np.tile(batch.column("id").to_numpy(), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], ["key", "id"])


def _near(percent: int) -> Callable:
    """Leave out pairs that cannot be linked: bits of one map alone are elements of one set alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            one, other = (_bytes_table(batch.column(c)) for c in ("map_a", "map_b"))
            n, m = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            both = np.minimum(n - np.bitwise_count(one & ~other).sum(1), m - np.bitwise_count(other & ~one).sum(1))
            near = pa.array(100 * both >= percent * (n + m - both))
            yield batch.select(["a", "b"]).filter(near)

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmer(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_a"), batch.column("set_b")
            keep = [
                linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(left, right)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(percent: int) -> Callable:
    """Links between two blocks of a family, enough of them to connect what is connected."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            ids, others = (t.column("id").to_numpy() for t in (left, right))
            own, labels = (t.column("label").to_numpy() for t in (left, right))
            mine, maps = (_bytes_table(t.column("map").combine_chunks()) for t in (left, right))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in right.column("set")]
            sizes = np.array([len(s) for s in sets])
            for i, s in enumerate(left.column("set")):
                this = np.frombuffer(s.as_buffer(), np.uint64)
                n, m = len(this), sizes
                only = np.bitwise_count(mine[i] & ~maps).sum(1), np.bitwise_count(maps & ~mine[i]).sum(1)
                both = np.minimum(n - only[0], m - only[1])
                joined = {int(own[i])}
                for j in np.flatnonzero(100 * both >= percent * (n + m - both)).tolist():
                    if int(labels[j]) not in joined and linked(this, sets[j], percent):
                        joined.add(int(labels[j]))
                        found.append((int(ids[i]), int(others[j])))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets have a shingle of each cell, as a few long rows per task."""
    counts = np.zeros(SKETCH_CELLS, np.int64)
    for batch in batches:
        for one in batch.column("set"):
            counts[_cells(np.frombuffer(one.as_buffer(), np.uint64))] += 1
    for part, cells in enumerate(np.split(counts, SKETCH_ROWS)):
        if cells.any():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([cells.tobytes()], pa.binary())], ["part", "cells"])


def _total(table: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(c.as_buffer(), np.int64) for c in table.column("cells"))
    return pa.table({"part": table.column("part").slice(0, 1), "cells": pa.array([counts.tobytes()], pa.binary())})


def prefix(size: int, percent: int) -> int:
    """Of the elements of a set in the common order, the first so many: a set linked to it has one of them."""
    return size - -(-percent * size // 100) + 1


def _prefixes(counts, percent: int) -> Callable:
    """(shingle, size, place, id, label): each set's shingles that a linked set must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = counts.value
        for batch in batches:
            shingles, lengths = [], []
            for one in batch.column("set"):
                found = np.frombuffer(one.as_buffer(), np.uint64)
                order = np.lexsort((found, frequent[_cells(found)]))
                shingles.append(found[order[: prefix(len(found), percent)]])
                lengths.append((len(found), len(shingles[-1])))
            sizes, taken = np.array(lengths, np.int64).reshape(-1, 2).T
            places = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
            flat = np.concatenate(shingles) if shingles else np.zeros(0, np.uint64)
            columns = [flat.view(np.int64), np.repeat(sizes, taken), places]
            columns += [np.repeat(batch.column(c).to_numpy(), taken) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "size", "place", "id", "label"])

    return run


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    percent: int = SIMILARITY,
) -> DataFrame:
    """(key, n_shingles, component_id, kept): the group of near duplicates of every document.

    Two documents are linked when the intersection of their sets of distinct word shingles (A-Z in lower
    case) is at least `percent` hundredths of the union; a group is what links reach, named by its
    smallest key, which is the one kept. `key` is an integer.

    Texts that are null, empty or without words have no shingles and are linked with nothing. Rows that
    share a key count as one document. Rows with a null key form no group and are kept. Other columns
    are not read, and an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    named = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    sketches = staged(
        named.mapInArrow(
            _sketcher("id", "text", shingle_words),
            "id bigint, n_shingles bigint, set_id binary, signature binary, map binary",
        ),
        "sketches",
    )
    folded = staged(
        sketches.filter("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("set_id")
        .agg(
            F.min("id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.first("map").alias("map"),
        ),
        "folded",
    )
    links = _links(named, folded, shingle_words, percent)
    same_id = _links_by_id(sketches, folded)
    group = components(links.union(same_id))
    named_sets = folded.select("set_id", F.col("id").alias("node")).join(group, "node", "left")
    found = named_sets.select("set_id", F.coalesce("component", "node").alias("component"))
    return (
        sketches.join(staged_rows(found, folded.count(), "set-groups"), "set_id", "left")
        .withColumn(
            "component_id",
            F.when(F.col("n_shingles") > 0, F.least("component", "id")).otherwise(F.col("id")),
        )
        .select(
            F.col("id").alias(key),
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
            F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def _links_by_id(sketches: DataFrame, folded: DataFrame) -> DataFrame:
    """Links between the texts of rows that share a key."""
    several = (
        sketches.filter("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("set_id").alias("least"), F.max("set_id").alias("most"))
        .filter("least <> most")
        .select("id")
    )
    texts = sketches.join(several, "id").select("set_id", F.col("id").alias("a")).distinct()
    return texts.join(folded.select("set_id", F.col("id").alias("b")), "set_id").select("a", "b")


def _links(named: DataFrame, folded: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between folded documents, enough to connect every group."""
    n = folded.count()
    parts = partitions_for(folded.sparkSession, n * SLOTS * KEY_BYTES, PARTITION_BYTES)
    # nearly all keys are single, so combining them before the shuffle would not pay
    keyed = folded.select("id", "signature").mapInArrow(bucket_keys, "key bigint, id bigint").repartition(parts, "key")
    buckets = staged(
        keyed.groupBy("key")
        .agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1"),
        "buckets",
    )
    members = staged(keyed.join(buckets, "key").filter("id <> center OR n > 2"), "members")
    pairs = members.filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(pairs, named, folded, size, percent, "links")
    return links.union(_late_links(members, named, folded, links, size, percent))


def _confirmed(
    pairs: DataFrame, named: DataFrame, folded: DataFrame, size: int, percent: int, name: str
) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; sets are made of those that the maps leave."""
    marks = lambda x: folded.select(
        F.col("id").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("map").alias(f"map_{x}")
    )
    near = staged(
        pairs.join(marks("b"), "b").join(marks("a"), "a").mapInArrow(_near(percent), "a bigint, b bigint"),
        f"{name}-near",
    )
    involved = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    sets = _sets(named, involved, folded.count(), size)
    return staged(
        near.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        .mapInArrow(_confirmer(percent), "a bigint, b bigint"),
        name,
    )


def _sets(named: DataFrame, ids: DataFrame, n: int, size: int) -> DataFrame:
    """Full shingle sets of some documents. Texts under one id give a set each, as they do in `folded`."""
    found = named.join(staged_rows(ids, n, "involved"), "id")
    return staged(found.mapInArrow(_set_maker(size), "id bigint, set binary"), "sets")


def _late_links(
    members: DataFrame, named: DataFrame, folded: DataFrame, links: DataFrame, size: int, percent: int
) -> DataFrame:
    """Links that the comparison with bucket centers left out."""
    group = components(links)
    crowded = members.filter("n > 2")
    n = crowded.count()
    labelled = staged_rows(
        crowded.join(group.withColumnRenamed("node", "id"), "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("label")
        ),
        n,
        "labelled",
    )
    several = F.min("label") < F.max("label")
    mixed = labelled.groupBy("key").agg(several.alias("mixed")).filter("mixed").select("key")
    meeting = staged_rows(
        labelled.join(staged_rows(mixed, n // 3, "mixed"), "key").select("id", "label").distinct(), n, "meeting"
    )
    sets = _sets(named, meeting.select("id"), folded.count(), size).join(meeting, "id")
    early = staged(_early_shingles(sets, percent), "early")
    # each document with some that share a shingle, for every shingle; then what that leaves unconnected
    pairs = _center_pairs(early, percent)
    first = _confirmed(pairs, named, folded, size, percent, "center-links")
    rest = _relabelled(early, components(links.union(first)))
    return first.union(_family_links(rest, sets.select("id", "set"), folded, percent))


def _relabelled(early: DataFrame, joined: DataFrame) -> DataFrame:
    """With the components so far as labels, and without the shingles that only one component has."""
    named = early.drop("label").join(joined.withColumnRenamed("node", "id"), "id", "left")
    label = F.coalesce("component", "id").alias("label")
    return staged(_mixed(named.select("shingle", "size", "place", "id", label)), "early")


def _mixed(early: DataFrame) -> DataFrame:
    """The shingles that documents of several labels share."""
    several = F.min("label") < F.max("label")
    shared = early.groupBy("shingle").agg(several.alias("mixed")).filter("mixed").select("shingle")
    return early.join(shared, "shingle")


def _early_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, size, place, id, label) of (id, label, set): the shingles that a linked set must share one of.

    Shingles are ordered by how many sets a sketch of bounded size counts for them, rare ones first.
    """
    counted = sets.select("set").mapInArrow(_count, "part bigint, cells binary")
    rows = counted.groupBy("part").applyInArrow(_total, "part bigint, cells binary").collect()  # SKETCH_CELLS numbers
    counts = np.zeros((SKETCH_ROWS, SKETCH_CELLS // SKETCH_ROWS), np.int64)
    for row in rows:
        counts[row.part] = np.frombuffer(row.cells, np.int64)
    run = _prefixes(sets.sparkSession.sparkContext.broadcast(counts.ravel()), percent)
    names = "shingle bigint, size bigint, place bigint, id bigint, label bigint"
    return _mixed(staged(sets.mapInArrow(run, names), "prefixes"))


def _can_be_linked(x: str, y: str, percent: int) -> Column:
    """With sizes n and m two linked sets have at least `percent` / (100 + percent) of n + m elements in
    common, so the first one they share has so many less one behind it in both."""
    n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
    rest = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place"))
    return ((100 + percent) * rest >= percent * (n + m)) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _center_pairs(early: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of some documents of each shingle and all others of another label that can be linked.

    Shingles choose CENTERS documents by hashes, so documents that share many of them meet in many pairings.
    """
    by_hash = [
        F.min(F.struct(F.xxhash64("shingle", "id", F.lit(i)).alias("_hash"), "id", "label", "size", "place"))
        for i in range(CENTERS)
    ]
    chosen = early.groupBy("shingle").agg(F.array_distinct(F.array(*by_hash)).alias("c"))
    center = chosen.select("shingle", F.explode("c").alias("c"))
    met = early.alias("x").join(center.select("shingle", "c.*").alias("y"), "shingle")
    met = met.filter((F.col("x.label") != F.col("y.label")) & _can_be_linked("x", "y", percent))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _active(early: DataFrame, percent: int) -> DataFrame:
    """The rows of `early` that a row of another label and the same shingle can be linked with.

    Sizes and places are compared, not documents.
    """
    spots = early.groupBy("shingle", "size", "place").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    one, other = spots.alias("x"), spots.alias("y")
    differ = (F.col("x.least") != F.col("y.most")) | (F.col("x.most") != F.col("y.least"))
    met = one.join(other, F.col("x.shingle") == F.col("y.shingle"))
    spot = ["shingle", "size", "place"]
    possible = met.filter(_can_be_linked("x", "y", percent) & differ).select("x.shingle", "x.size", "x.place").distinct()
    return early.join(possible, spot, "left_semi")


def _family_links(early: DataFrame, sets: DataFrame, folded: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different labels that share a shingle early enough.

    Documents that meet so, over any number of shingles, form a family. Those outside its largest label
    are compared with all of it, BLOCK_DOCS against BLOCK_DOCS inside tasks that return links only.
    """
    active = staged(_active(early, percent), "active")
    hub = active.groupBy("shingle").agg(F.min("id").alias("b"))
    family = components(active.join(hub, "shingle").select(F.col("id").alias("a"), "b").distinct())
    placed = staged(
        active.select("id", "label")
        .distinct()
        .join(family.select(F.col("node").alias("id"), F.col("component").alias("family")), "id"),
        "placed",
    )
    largest = (
        placed.groupBy("family", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("family")
        .agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
        .select(
            "family",
            F.col("top.label").alias("top"),
            F.ceil(F.col("all") / BLOCK_DOCS).alias("blocks"),
            F.ceil((F.col("all") - F.col("top.n")) / BLOCK_DOCS).alias("outer_blocks"),
        )
    )
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    whole = (
        placed.join(largest, "family")
        .withColumn("block", F.pmod(place, F.col("blocks")))
        .withColumn("outer_block", F.pmod(place, F.col("outer_blocks")))
        .join(sets, "id")
        .join(folded.select("id", "map"), "id")
    )
    whole = staged(whole, "families")
    outer = whole.filter("label <> top").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    inner = whole.withColumn("outer_block", F.explode(F.expr("sequence(0L, outer_blocks - 1)")))
    keys = ["family", "outer_block", "block"]
    columns = [*keys, "id", "label", "map", "set"]
    return staged(
        outer.select(columns)
        .groupBy(keys)
        .cogroup(inner.select(columns).groupBy(keys))
        .applyInArrow(_block_links(percent), "a bigint, b bigint"),
        "late-links",
    )

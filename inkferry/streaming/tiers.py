"""Partial results of micro-batches, compacted as they come.

Each batch writes one folder. After every FAN folders of one size they are merged into a folder FAN times
as long, within the batch that completes them; so the state before batch n is read from at most
(FAN - 1) * log(n) folders, and a row is rewritten log(n) times. Names follow from the batch numbers, and
a batch only reads folders that earlier batches finished: running it again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

Merge = Callable[[DataFrame], DataFrame]
FAN = 4


def spans(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """Finished folders that together hold batches 0 to n - 1, largest first."""
    size = 1
    while size * fan <= n:
        size *= fan
    out, at = [], 0
    while size:
        while at + size <= n:
            out.append((at, at + size))
            at += size
        size //= fan
    return out


def _folder(path: str, span: tuple[int, int]) -> str:
    return f"{path}/{span[0]}-{span[1]}"


def _union(like: DataFrame, path: str, found: list[tuple[int, int]]) -> DataFrame:
    spark = like.sparkSession
    parts = [spark.read.schema(like.schema).parquet(_folder(path, s)) for s in found]
    return reduce(DataFrame.unionByName, parts) if parts else like.limit(0)


def put(partial: DataFrame, path: str, batch_id: int, merge: Merge, fan: int = FAN) -> DataFrame:
    """Write a batch's partial result, and every merged folder that it completes; returns it, reread."""
    one = (batch_id, batch_id + 1)
    partial.write.mode("overwrite").parquet(_folder(path, one))
    written = partial.sparkSession.read.schema(partial.schema).parquet(_folder(path, one))
    end, size = batch_id + 1, fan
    while end % size == 0:
        step = size // fan
        parts = [(a, a + step) for a in range(end - size, end, step)]
        whole = merge(_union(written, path, parts)).select(*partial.columns)
        whole.write.mode("overwrite").parquet(_folder(path, (end - size, end)))
        size *= fan
    return written


def before(like: DataFrame, path: str, batch_id: int, merge: Merge) -> DataFrame:
    """The merged result of all batches before `batch_id`; `like` has its columns."""
    return merge(_union(like, path, spans(batch_id)))

"""Looking up the entries of an array column in a keyed table without moving the wide rows twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.operators.skew import skew_join


def attach_map(
    posts: DataFrame,
    id_columns: list[str],
    keys: Column,
    table: DataFrame,
    out: str,
    item_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Add a map from the post's own keys to the `value` of `table(key, value)`.

    `keys` is an array; take it from a narrow column, so that the content is not read for it. Only
    (post, key) pairs travel to the table, and a key that many posts share is salted. The maps are as
    small as the post's key list and come back to the posts in one join on the unique id.
    `item_columns` are further columns of both sides that the key is looked up under, such as the
    item id.
    """
    pairs = posts.select(
        *id_columns,
        *[c for c in item_columns if c not in id_columns],
        F.explode(F.array_distinct(keys)).alias("key"),
    )
    found = skew_join(pairs, table, [*item_columns, "key"], "inner", spread_by=id_columns[0])
    maps = found.groupBy(*id_columns).agg(
        F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias(out)
    )
    return posts.join(maps, id_columns, "left")

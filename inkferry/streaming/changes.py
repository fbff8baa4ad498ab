"""Change feeds: which rows of a result entered, left or changed with each micro-batch.

The state is a mergeable partial result in tiers (see `tiers`). A batch looks up the old state of its own
keys only, merges itself into it and writes the difference; so its cost follows the batch, apart from
the look-up. The changes of all batches add up to the current result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry.operators.skew import staged
from inkferry.streaming import tiers

View = Callable[[DataFrame], DataFrame]
ENTERED, CHANGED, LEFT = "entered", "changed", "left"


def differences(was: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, change, old, new) of two keyed tables that differ; the other columns are the structs.

    A key that is in one table only entered or left. Null keys and null values are values like others.
    """
    values = [c for c in now.columns if c not in keys]
    wrap = lambda df, name: df.select(
        *keys, F.struct(F.lit(True).alias("_there"), *values).alias(name)
    )
    same_key = [F.col(f"w.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    met = wrap(was, "old").alias("w").join(wrap(now, "new").alias("n"), same_key, "full")
    kind = (
        F.when(F.col("old").isNull(), ENTERED)
        .when(F.col("new").isNull(), LEFT)
        .when(~F.col("old").eqNullSafe(F.col("new")), CHANGED)
    )
    there = F.col("new").isNotNull()
    named = [F.when(there, F.col(f"n.{k}")).otherwise(F.col(f"w.{k}")).alias(k) for k in keys]
    out = met.select(*named, kind.alias("change"), "old", "new").filter("change IS NOT NULL")
    if not values:
        return out.drop("old", "new")
    return out.withColumns({c: F.col(c).dropFields("_there") for c in ("old", "new")})


def run_changes(
    stream: DataFrame,
    of_batch: View,
    merge: View,
    keys: list[str],
    path: str,
    checkpoint: str,
    view: View = lambda state: state,
) -> None:
    """Keep a merged state by `keys` and write what each batch changes in `view` of it.

    `of_batch` gives a batch's partial result, `merge` folds partial results by `keys`, `view` turns the
    state into the result rows, key by key. `path`/changes/batch_id=n has the differences.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        partial = tiers.put(of_batch(batch), f"{path}/state", batch_id, merge)
        touched = partial.select(*keys).distinct().alias("t")
        state = tiers.before(partial, f"{path}/state", batch_id, merge).alias("s")
        own = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        old = staged(state.join(touched, own, "left_semi"), "old-state")
        new = merge(old.unionByName(partial))
        found = differences(view(old), view(new), keys)
        found.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes so far, with the batch that made them."""
    return spark.read.parquet(f"{path}/changes")


def current(feed: DataFrame, keys: list[str]) -> DataFrame:
    """The result as the sum of its changes: the keys whose last change did not take them out, with `new`."""
    newest = F.max_by(F.struct(*[c for c in feed.columns if c not in keys]), "batch_id").alias("last")
    kept = feed.groupBy(*keys).agg(newest).filter(F.col("last.change") != LEFT)
    return kept.select(*keys, *(["last.new.*"] if "new" in feed.columns else []))

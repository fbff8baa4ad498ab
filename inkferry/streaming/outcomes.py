"""Upload outcomes as a stream: each batch patches items, extends the post map and sets refused rows aside.

All sinks of a batch are folders named by its number, and a batch reads only what earlier batches
wrote; so running one again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry import schemas
from inkferry.operators.ledger import extend_post_map
from inkferry.operators.skew import staged
from inkferry.streaming import tiers

OUTCOME = "id BIGINT, seq BIGINT, status STRING, dest_post_id BIGINT, error_message STRING"
PATCH = "id BIGINT, seq BIGINT, field STRING, value STRING"
MAPPED = "id BIGINT, post_url STRING, dest_post_id BIGINT"
REFUSED = "id BIGINT, seq BIGINT, reason STRING"
UNKNOWN_ITEM, BAD_STATUS, NO_POST = "unknown item", "status not allowed", "completed without a post"


def _checked(outcomes: DataFrame, items: DataFrame) -> DataFrame:
    """Outcomes with their post and the `reason` to refuse them. Items have one row per id."""
    known = items.select("id", "post_url")
    met = outcomes.join(known, "id", "left")
    allowed = F.coalesce(F.col("status").isin(*schemas.RUN_STATES), F.lit(False))
    reason = (
        F.when(F.col("post_url").isNull(), UNKNOWN_ITEM)
        .when(~allowed, BAD_STATUS)
        .when((F.col("status") == "completed") & F.col("dest_post_id").isNull(), NO_POST)
    )
    return met.withColumn("reason", reason)


def _patches(outcomes: DataFrame) -> DataFrame:
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(name).cast("string").alias("value"))
            for name in ("status", "dest_post_id", "error_message")
        ]
    )
    return outcomes.select("id", "seq", F.explode(fields).alias("p")).select("id", "seq", "p.*")


def settle(outcomes: DataFrame, items: DataFrame, post_map: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patches, new map rows, refused) of one batch of outcomes(id, seq, status, dest_post_id, error_message).

    An outcome is refused if its item is unknown, its status not allowed, or it is completed without a
    post. The newest completion of an item goes to the post map, in the order of the item ids; one that
    the map rejects is refused with the map's reason and its item set to failed. A completion that the map
    has already, because it is delivered again, is patched but not mapped twice.
    """
    checked = staged(_checked(outcomes, items), "outcomes")
    sound = checked.filter("reason IS NULL").drop("reason")
    newest = F.max_by(F.struct("seq", "post_url", "dest_post_id"), "seq").alias("o")
    done = sound.filter("status = 'completed'").groupBy("id").agg(newest).select("id", "o.*")
    there = post_map.select("post_url", "dest_post_id")
    new = done.join(there, ["post_url", "dest_post_id"], "left_anti")
    accepted, rejected = extend_post_map(post_map, new.select("id", "post_url", "dest_post_id"))
    rejected = staged(rejected.select("id", "reason").join(new.select("id", "seq"), "id"), "rejected")
    lost = rejected.select(
        "id",
        "seq",
        F.lit("failed").alias("status"),
        F.lit(None).cast("bigint").alias("dest_post_id"),
        F.col("reason").alias("error_message"),
    )
    kept = sound.join(rejected.select("id", "seq"), ["id", "seq"], "left_anti")
    patches = _patches(kept.select(lost.columns).unionByName(lost)).distinct()
    refused = checked.filter("reason IS NOT NULL").select("id", "seq", "reason")
    return patches, accepted, refused.unionByName(rejected.select("id", "seq", "reason"))


def run_outcomes(
    stream: DataFrame, items: DataFrame, post_map: DataFrame, path: str, checkpoint: str
) -> None:
    """Process all outcomes available. `items` and `post_map` are the tables as they were at the start;
    what the stream adds lies under `path`: see `patches`, `mapped` and `refused`."""
    union = lambda rows: rows

    def advance(batch: DataFrame, batch_id: int) -> None:
        like = batch.sparkSession.createDataFrame([], MAPPED)
        start = post_map.select([c.split()[0] for c in MAPPED.split(", ")])
        grown = staged(start.unionByName(tiers.before(like, f"{path}/mapped", batch_id, union)), "map")
        patched, accepted, out = settle(batch, items, grown)
        tiers.put(accepted, f"{path}/mapped", batch_id, union)
        patched.write.mode("overwrite").parquet(f"{path}/patches/batch_id={batch_id}")
        out.write.mode("overwrite").parquet(f"{path}/refused/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(advance)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def patches(spark: SparkSession, path: str) -> DataFrame:
    """The patches of all batches, for `ledger.apply_patches`."""
    return spark.read.schema(PATCH).parquet(f"{path}/patches")


def mapped(spark: SparkSession, path: str, n_batches: int) -> DataFrame:
    """The rows that the first `n_batches` batches added to the post map."""
    return tiers.before(spark.createDataFrame([], MAPPED), f"{path}/mapped", n_batches, lambda rows: rows)


def refused(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes that were set aside, with the reason and the batch."""
    return spark.read.schema(f"{REFUSED}, batch_id BIGINT").parquet(f"{path}/refused")

"""Categories and tags at the destination, and the payloads that refer to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.functions.text import iso_utc
from inkferry.operators.extract import is_refused, post_errors
from inkferry.operators.ledger import assign_ids
from inkferry.operators.lookup import attach_map
from inkferry.operators.skew import skew_join, staged


def used_terms(posts: DataFrame, order: str) -> DataFrame:
    """Distinct term names with their first use: posts by `order`, a parent just before its child."""
    categories = posts.select(F.col(order).alias("_post"), F.posexplode("categories").alias("_i", "c"))
    own = categories.select(
        F.lit("category").alias("taxonomy"),
        F.col("c.name").alias("name"),
        F.struct("_post", F.lit(0).alias("k"), (F.col("_i") * 2 + 1).alias("i"), F.col("c.parent_name").alias("parent")).alias("use"),
    )
    parents = categories.filter(F.col("c.parent_name").isNotNull()).select(
        F.lit("category").alias("taxonomy"),
        F.col("c.parent_name").alias("name"),
        F.struct("_post", F.lit(0).alias("k"), (F.col("_i") * 2).alias("i"), F.lit(None).cast("string").alias("parent")).alias("use"),
    )
    tags = posts.select(F.col(order).alias("_post"), F.posexplode("tags").alias("_i", "t")).select(
        F.lit("tag").alias("taxonomy"),
        F.col("t.name").alias("name"),
        F.struct("_post", F.lit(1).alias("k"), F.col("_i").alias("i"), F.lit(None).cast("string").alias("parent")).alias("use"),
    )
    return (
        own.unionByName(parents)
        .unionByName(tags)
        .groupBy("taxonomy", "name")
        .agg(F.min("use").alias("use"))
    )


def ensure_terms(posts: DataFrame, existing_terms: DataFrame, order: str = "url") -> DataFrame:
    """One id per term name: the lowest existing id of exactly that name, or a new one.

    New ids follow the first use. The parent is not part of the lookup; it only goes into new terms.
    """
    known = existing_terms.groupBy("taxonomy", "name").agg(F.min("id").alias("id"))
    matched = staged(
        used_terms(posts, order).join(known, ["taxonomy", "name"], "left"), "used-terms"
    )
    no_parent = F.lit(None).cast("string").alias("parent_name")
    found = matched.filter(F.col("id").isNotNull()).select(
        "taxonomy", "name", "id", F.lit(False).alias("is_new"), no_parent
    )
    fresh = matched.filter(F.col("id").isNull()).select(
        "taxonomy", "name", "use._post", "use.k", "use.i", F.col("use.parent").alias("parent_name")
    )
    created = assign_ids(fresh, ["_post", "k", "i", "taxonomy", "name"], existing_terms).select(
        "taxonomy", "name", "id", F.lit(True).alias("is_new"), "parent_name"
    )
    terms = found.unionByName(created)
    parents = terms.filter(F.col("taxonomy") == "category").select(
        F.col("name").alias("parent_name"), F.col("id").alias("parent_id")
    )
    children = skew_join(
        created.filter(F.col("parent_name").isNotNull()), parents, ["parent_name"], "left", spread_by="name"
    )
    roots = terms.filter(F.col("parent_name").isNull()).withColumn("parent_id", F.lit(0).cast("bigint"))
    return children.unionByName(roots).select("taxonomy", "name", "id", "is_new", "parent_id")


def _ids(names: Column, taxonomy: str) -> Column:
    return F.transform(names, lambda t: F.try_element_at("_ids", F.concat(F.lit(f"{taxonomy}:"), t["name"])))


def build_payloads(
    posts: DataFrame,
    terms: DataFrame,
    status: str = "pending",
    featured_media: DataFrame | None = None,
    id_columns: tuple[str, ...] = ("row_id",),
) -> tuple[DataFrame, DataFrame]:
    """Rows ready for an uploader, and the posts that cannot be sent with their message.

    `featured_media(url, featured_media)` holds the uploaded featured images; NULL and 0 are left out.
    """
    keys = F.concat(
        F.transform("categories", lambda c: F.concat(F.lit("category:"), c["name"])),
        F.transform("tags", lambda t: F.concat(F.lit("tag:"), t["name"])),
    )
    table = terms.select(F.concat_ws(":", "taxonomy", "name").alias("key"), F.col("id").alias("value"))
    errors = post_errors(posts).drop("blog_url")
    ready = attach_map(posts.filter(~is_refused()), list(id_columns), keys, table, "_ids")
    if featured_media is not None:
        one_each = featured_media.groupBy("url").agg(F.max("featured_media").alias("featured_media"))
        # found by narrow rows, so that the content stays where the terms' join put it
        ids = list(id_columns)
        found = skew_join(posts.select(*ids, "url"), one_each, ["url"], "inner", spread_by=ids[0])
        ready = ready.join(found.select(*ids, "featured_media"), ids, "left")
    else:
        ready = ready.withColumn("featured_media", F.lit(None).cast("bigint"))
    payloads = ready.select(
        "url",
        "title",
        "content",
        F.lit(status).alias("status"),
        iso_utc(F.col("publish_date")).alias("date"),
        _ids(F.col("categories"), "category").alias("categories"),
        _ids(F.col("tags"), "tag").alias("tags"),
        F.when(F.col("featured_media") != 0, F.col("featured_media")).alias("featured_media"),
    )
    return payloads, errors

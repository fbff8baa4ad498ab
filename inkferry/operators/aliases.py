"""Addresses that lead to one post: written differently, or redirected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.operators.components import components
from inkferry.operators.skew import skew_join, staged


def address_key(url: Column) -> Column:
    """An address without what does not tell pages apart: scheme, case of the host, the scheme's usual
    port, slashes at the end of the path, an empty query, and the fragment. Other texts than http(s)
    addresses stay."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^(?i)https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"\?$", "")
    rest = F.regexp_replace(rest, r"/+(?=\?|$)", "")
    return F.when(url.rlike(r"^(?i)https?://[^/?#]"), F.concat(host, rest)).otherwise(url)


def alias_classes(redirects: DataFrame) -> DataFrame:
    """(key, class) of all addresses in redirects(from_url, to_url); chains and loops are one class, named
    by its smallest key. An address without a redirect is its own class and has no row."""
    edges = redirects.select(address_key(F.col("from_url")).alias("a"), address_key(F.col("to_url")).alias("b"))
    return components(edges.filter("a IS NOT NULL AND b IS NOT NULL")).select(
        F.col("node").alias("key"), F.col("component").alias("class")
    )


def _classed(rows: DataFrame, url: str, classes: DataFrame, spread_by: str) -> DataFrame:
    keyed = rows.withColumn("key", address_key(F.col(url)))
    met = skew_join(keyed, classes, ["key"], "left", spread_by=spread_by)
    return met.withColumn("class", F.coalesce("class", "key")).drop("key")


def resolve_aliased_links(links: DataFrame, post_map: DataFrame, redirects: DataFrame) -> DataFrame:
    """Internal links with their target's destination post, whichever of its addresses they use.

    A class with several mapped posts resolves to the one mapped under the very address, else to the one
    of the smallest map id. Links without one are dangling.
    """
    classes = staged(alias_classes(redirects), "alias-classes")
    mapped = _classed(post_map.select("id", "post_url", "dest_post_id"), "post_url", classes, "id")
    by_class = mapped.groupBy("class").agg(F.min_by("dest_post_id", "id").alias("_by_class"))
    exact = post_map.groupBy(F.col("post_url").alias("target_url")).agg(F.min_by("dest_post_id", "id").alias("_exact"))
    met = skew_join(_classed(links, "target_url", classes, "id"), by_class, ["class"], "left", spread_by="id")
    met = skew_join(met, exact, ["target_url"], "left", spread_by="id")
    found = F.coalesce("_exact", "_by_class")
    return met.withColumn("dest_post_id", found).withColumn("dangling", found.isNull()).drop("_exact", "_by_class", "class")

"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkferry import schemas
from inkferry.functions.text import js_trim, resolve_url


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages, one row per address."""
    return trimmed_pages(spark.read.schema(schemas.PAGES).parquet(path))


def trimmed_pages(pages: DataFrame) -> DataFrame:
    """Pages with absolute addresses and trimmed text; a relative path hangs below the blog."""
    address = F.coalesce(resolve_url(F.col("blog_url"), F.col("url")), F.col("url"))
    return pages.withColumns({"url": address, "html": js_trim(F.col("html"))})


def read_list_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LIST_PAGES).parquet(path)


def read_fetched_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FETCHED_PAGES).parquet(path)


def read_existing_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EXISTING_TERMS).parquet(path)


def read_history(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five history tables, each with its declared schema."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}")
        for name, schema in schemas.HISTORY.items()
    }

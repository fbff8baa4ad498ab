"""Writing results: posts, payloads, history rows and the two JSON reports.

A report is one JSON document. Its lines are sorted over many tasks, and the part files, read in
name order, are the document; no task ever holds a whole report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry.operators.history import failed_posts_report, links_by_job
from inkferry.operators.ledger import new_history_rows
from inkferry.operators.skew import skew_join

UNKNOWN_BLOG = "unknown"
LINK_FIELDS = ("source_url", "target_url", "link_text", "context")


def write_posts(posts: DataFrame, path: str, replace: bool = False) -> None:
    """Posts as parquet, one folder per blog. With `replace` the blogs in `posts` are written anew and
    all others stay as they are.

    Rebalancing gathers a blog's posts in few files, and adaptive execution splits a hot blog.
    """
    balanced = posts.hint("rebalance", "blog_url")
    writer = balanced.write.mode("overwrite" if replace else "append").partitionBy("blog_url")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def post_table(posts: DataFrame, name: str, n_buckets: int, key: str = "row_id") -> DataFrame:
    """Posts as a table of the warehouse, bucketed by their row id.

    This moves the content for the last time: cards, uploads and term ids come to it by row id, so
    their joins only shuffle the small side. Choose as many buckets as shuffle partitions, or more.
    """
    dealt = posts.repartition(n_buckets, key)
    dealt.write.mode("overwrite").bucketBy(n_buckets, key).sortBy(key).saveAsTable(name)
    return posts.sparkSession.table(name)


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One JSON object per payload; a missing featured image leaves the field out."""
    payloads.write.mode("append").option("ignoreNullFields", "true").json(path)


def append_rows(table: str, rows: DataFrame, now: Column, path: str) -> None:
    """Append rows with ids to a history table, filling in the insert defaults."""
    new_history_rows(table, rows, now).write.mode("append").parquet(path)


def link_items(
    links: DataFrame, items: DataFrame, jobs: DataFrame, job_id: int | None = None
) -> DataFrame:
    """Every link of a job (or of all jobs) as its JSON entry, with the blog of the job."""
    entry = F.to_json(F.struct(*LINK_FIELDS))
    found = links_by_job(links, items, job_id).select("job_id", "id", entry.alias("item"))
    blogs = jobs.select(F.col("id").alias("job_id"), "blog_url")
    return skew_join(found, blogs, ["job_id"], "left", spread_by="id").select(
        "job_id", F.coalesce("blog_url", F.lit(UNKNOWN_BLOG)).alias("blog_url"), F.col("id").alias("ord"), "item"
    )


def failed_post_items(report: DataFrame) -> DataFrame:
    """The failed-posts report as pieces of JSON, one per message.

    A post's first piece opens its entry, and the next post's first piece closes it, so an entry of any
    length is written by many tasks.
    """
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("error_message").alias("m"))), r"(?s)^\{\"m\":(.*)\}$", 1)
    address = F.regexp_extract(F.to_json(F.struct(F.col("post_url").alias("u"))), r"(?s)^\{\"u\":(.*)\}$", 1)
    opening = F.concat(F.lit('{"post_url":'), address, F.lit(',"error_messages":['))
    item = F.when(F.col("n") <= 1, F.concat(opening, quoted)).otherwise(F.concat(F.lit(","), quoted))
    return report.select("blog_url", F.col("first_id").alias("ord"), "n", item.alias("item"))


def document_lines(
    items: DataFrame, order: list[str], count: Column, blog_url: Column, exported_at: Column, parted: bool = False
) -> DataFrame:
    """The lines of one JSON document: a head line, one line per item, a closing line.

    With `parted`, the last column of `order` numbers the pieces of an item: the first piece (0 or 1)
    closes the item before, and the closing line the last one.
    """
    totals = items.agg(F.min(F.struct(*order)).alias("first"), count.alias("count"))
    when = F.date_format(exported_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    head = F.to_json(
        F.struct(blog_url.alias("blog_url"), when.alias("exported_at"), F.col("count"))
    )
    place = [F.lit(0).cast("bigint").alias(c) for c in order]
    between = F.when(F.struct(*order) == totals.select("first").scalar(), "").otherwise("]}," if parted else ",")
    end = F.when(F.col("count") > 0, "]}]}").otherwise("]}") if parted else F.lit("]}")
    if parted:
        between = F.when(F.col(order[-1]) <= 1, between).otherwise("")
    opening = totals.select(
        F.lit(0).alias("section"), *place, F.regexp_replace(head, r"\}$", ',"items":[').alias("line")
    )
    body = items.select(
        F.lit(1).alias("section"),
        *[F.col(c).cast("bigint").alias(c) for c in order],
        F.concat(between, "item").alias("line"),
    )
    closing = totals.select(F.lit(2).alias("section"), *place, end.alias("line"))
    return opening.unionByName(body).unionByName(closing)


def write_document(lines: DataFrame, order: list[str], path: str) -> None:
    sort = ["section", *order]
    lines.repartitionByRange(*sort).sortWithinPartitions(*sort).select("line").write.text(path)


def links_document(
    links: DataFrame, items: DataFrame, jobs: DataFrame, job_id: int, now: Column
) -> DataFrame:
    """Lines of the link report of one job; a job that does not exist reports the blog as unknown."""
    found = link_items(links, items, jobs, job_id)
    blog = jobs.filter(F.col("id") == job_id).agg(F.max("blog_url")).scalar()
    return document_lines(found, ["ord"], F.count(F.lit(1)), F.coalesce(blog, F.lit(UNKNOWN_BLOG)), now)


def failed_posts_document(items: DataFrame, jobs: DataFrame, blog_url: str, now: Column) -> DataFrame:
    """Lines of the failed-posts report of one blog; `count` is the number of posts."""
    report = failed_post_items(failed_posts_report(items, jobs, blog_url))
    count = F.count_if(F.col("n") <= 1)
    return document_lines(report, ["ord", "n"], count, F.lit(blog_url), now, parted=True)


def export_links(
    links: DataFrame, items: DataFrame, jobs: DataFrame, job_id: int, path: str, now: Column
) -> None:
    write_document(links_document(links, items, jobs, job_id, now), ["ord"], path)


def export_failed_posts(
    items: DataFrame, jobs: DataFrame, path: str, blog_url: str, now: Column
) -> None:
    write_document(failed_posts_document(items, jobs, blog_url, now), ["ord", "n"], path)

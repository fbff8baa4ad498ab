"""Changing the history: plain tables have no UPDATE, keys or cascades, so these compute the result."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkferry import schemas
from inkferry.operators.components import components
from inkferry.operators.history import items_of_blogs
from inkferry.operators.skew import checkpoint_dir, number_rows, skew_join, staged

# The fields a patch may set, per table.
PATCHABLE = {
    "post_jobs": ("status", "completed_at", "error_message"),
    "job_items": ("status", "dest_post_id", "error_message", "updated_at"),
    "image_assets": ("status", "dest_media_id", "dest_media_url", "error_message", "updated_at"),
}
URL_TAKEN, ID_TAKEN = "post_url already mapped", "dest_post_id already mapped"
URL_NULL, ID_NULL = "post_url is null", "dest_post_id is null"
GROUP_ROWS = 100_000  # of clashing map rows that one task inserts in order
INITIAL_STATUS = {"post_jobs": "running", "job_items": "running", "image_assets": "pending"}


def assign_ids(new_rows: DataFrame, order: list[str], existing: DataFrame) -> DataFrame:
    """Give rows the ids after the highest existing one, in `order` (which ends in a unique column)."""
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return number_rows(new_rows, order, "_n").withColumn("id", F.col("_n") + highest).drop("_n")


def new_history_rows(table: str, rows: DataFrame, now: Column) -> DataFrame:
    """Rows of a history table with the defaults of an insert; `rows` must carry its ids."""
    defaults = {"created_at": now, "updated_at": now}
    if table in INITIAL_STATUS:
        defaults["status"] = F.lit(INITIAL_STATUS[table])
    columns = []
    for field in schemas.HISTORY[table].split(", "):
        name, kind = field.split(" ")
        if name in rows.columns:
            value = F.col(name)
        else:
            value = defaults.get(name, F.lit(None))
        columns.append(value.cast(kind).alias(name))
    return rows.select(*columns)


def _free_of(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows with the `reason` that rows already taken give against them, NULL if none."""
    by_url = taken.select("post_url").distinct().withColumn("_url_taken", F.lit(True))
    by_id = taken.select("dest_post_id").distinct().withColumn("_id_taken", F.lit(True))
    checked = skew_join(rows, by_url, ["post_url"], "left", spread_by="id")
    checked = skew_join(checked, by_id, ["dest_post_id"], "left", spread_by="id")
    reason = F.when(F.col("_url_taken"), URL_TAKEN).when(F.col("_id_taken"), ID_TAKEN)
    return checked.withColumn("reason", reason).drop("_url_taken", "_id_taken")


def _settle_groups(rows: DataFrame) -> DataFrame:
    """Rows (id, post_url, dest_post_id, group) with their `reason`, each group inserted row by row."""

    def insert(group: pa.Table) -> pa.Table:
        urls, ids, reasons = set(), set(), []
        group = group.sort_by("id")
        for row in group.to_pylist():
            url, dest = row["post_url"], row["dest_post_id"]
            reason = URL_TAKEN if url in urls else ID_TAKEN if dest in ids else None
            if reason is None:
                urls.add(url)
                ids.add(dest)
            reasons.append(reason)
        return group.drop_columns(["group"]).append_column("reason", pa.array(reasons, pa.string()))

    return rows.groupBy("group").applyInArrow(
        insert, "id bigint, post_url string, dest_post_id bigint, reason string"
    )


def _peel(open_rows: DataFrame) -> DataFrame:
    """The same for groups too large for one task, by rounds over all of them.

    A row that comes first for both its keys is certain; certain rows reject those they clash with;
    each round works on what the round before left over. The results of the rounds lie in one folder.
    """
    spark = open_rows.sparkSession
    path = f"{checkpoint_dir(spark)}/staged/settled-{uuid.uuid4().hex}"
    columns = ["id", "post_url", "dest_post_id"]
    while not open_rows.isEmpty():
        first_url = open_rows.groupBy("post_url").agg(F.min("id").alias("id"))
        first_id = open_rows.groupBy("dest_post_id").agg(F.min("id").alias("id"))
        certain = staged(first_url.join(first_id, "id"), "certain")
        others = open_rows.join(certain.select("id"), "id", "left_anti")
        checked = staged(_free_of(others, certain), "checked")
        sure = certain.select(*columns, F.lit(None).cast("string").alias("reason"))
        out = checked.filter("reason IS NOT NULL").select(*columns, "reason")
        sure.unionByName(out).write.mode("append").parquet(path)
        open_rows = checked.filter("reason IS NULL").select(*columns)
    schema = "id BIGINT, post_url STRING, dest_post_id BIGINT, reason STRING"
    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _by_url(open_rows: DataFrame) -> DataFrame:
    """The rows with `first`, if they come first of their address, and `tangled`, if a row of their address
    shares its destination id with another row. A row that is not tangled clashes by its address alone."""
    counts = open_rows.groupBy("dest_post_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = staged(counts.select("dest_post_id", F.lit(True).alias("shared")), "shared-ids")
    if shared.isEmpty():
        marked = open_rows.withColumn("shared", F.lit(False))
    else:
        met = skew_join(open_rows, shared, ["dest_post_id"], "left", spread_by="id")
        marked = met.withColumn("shared", F.coalesce("shared", F.lit(False)))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "dest_post_id")
    urls = marked.groupBy("post_url").agg(F.min(place).alias("_first"), F.max("shared").alias("tangled"))
    met = skew_join(open_rows, urls, ["post_url"], "inner", spread_by="dest_post_id")
    return met.select(*open_rows.columns, (place == F.col("_first")).alias("first"), "tangled")


def _untangled(open_rows: DataFrame) -> DataFrame:
    """The rows with their `reason`, group by group of rows that share addresses or ids."""
    columns = ["id", "post_url", "dest_post_id"]
    edges = open_rows.select(
        F.concat(F.lit("u"), "post_url").alias("a"), F.concat(F.lit("d"), F.col("dest_post_id").cast("string")).alias("b")
    )
    named = open_rows.withColumn("node", F.concat(F.lit("d"), F.col("dest_post_id").cast("string")))
    group = components(edges).withColumnRenamed("component", "group")
    grouped = staged(skew_join(named, group, ["node"], "left", spread_by="id").drop("node"), "grouped")
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS)
    large = staged(sizes.select("group"), "large-groups")
    small = grouped.join(large, "group", "left_anti").select(*columns, "group")
    settled = staged(_settle_groups(small), "settled")
    rest = _peel(staged(grouped.join(large, "group", "left_semi").select(*columns), "open"))
    return settled.unionByName(rest)


def extend_post_map(post_map: DataFrame, new_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split new map rows into accepted and rejected ones, as if inserted one by one by id.

    Both the address and the destination id are unique and not null, and a rejected row blocks nothing.
    Rows without one of them are rejected before anything is compared. Rows that clash with the table so
    far are rejected. Where the rows of an address share no id with others, the first one is accepted. What
    is left falls into groups that share addresses or ids; each group is inserted in order by one task,
    however long its chains, and only groups of more than GROUP_ROWS rows take rounds over the whole table.
    """
    columns = ["id", "post_url", "dest_post_id"]
    new = new_rows.select(
        F.col("id").cast("bigint").alias("id"), "post_url", F.col("dest_post_id").cast("bigint").alias("dest_post_id")
    )
    null_key = F.when(F.col("post_url").isNull(), URL_NULL).when(F.col("dest_post_id").isNull(), ID_NULL)
    keyless = new.withColumn("reason", null_key).filter("reason IS NOT NULL")
    keyed = new.filter("post_url IS NOT NULL AND dest_post_id IS NOT NULL")
    checked = staged(_free_of(keyed, post_map).unionByName(keyless), "checked")
    by_url = staged(_by_url(checked.filter("reason IS NULL").select(*columns)), "by-url")
    plain = by_url.filter(~F.col("tangled")).select(*columns, F.when(~F.col("first"), URL_TAKEN).alias("reason"))
    tangled = by_url.filter("tangled").select(*columns)
    decided = plain if tangled.isEmpty() else plain.unionByName(_untangled(tangled))
    accepted = decided.filter("reason IS NULL").select(*columns)
    rejected = checked.filter("reason IS NOT NULL").unionByName(decided.filter("reason IS NOT NULL"))
    return accepted, rejected.select(*columns, "reason")


def apply_patches(table: str, rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Current rows after a log of patches `(id, seq, field, value)`.

    The last value of each field wins. A field without a patch stays; a patch with a NULL value sets
    NULL, hence the struct around the value.
    """
    types = dict(rows.dtypes)
    latest = patches.groupBy("id").agg(
        *[
            F.max_by(F.struct("value"), F.when(F.col("field") == name, F.col("seq"))).alias(f"_{name}")
            for name in PATCHABLE[table]
        ]
    )
    patched = rows.join(latest, "id", "left")
    for name in PATCHABLE[table]:
        patch = F.col(f"_{name}")
        patched = patched.withColumn(
            name, F.when(patch.isNotNull(), patch["value"].cast(types[name])).otherwise(F.col(name))
        )
    return patched.select(*rows.columns)


def cascade_delete(history: dict[str, DataFrame], job_ids: DataFrame) -> dict[str, DataFrame]:
    """The history without some jobs and all that hangs on them; the post map stays."""
    gone = job_ids.select("job_id").distinct()
    items = history["job_items"]
    marked = skew_join(
        items, gone.withColumn("_gone", F.lit(True)), ["job_id"], "left", spread_by="id"
    )
    gone_items = staged(marked.filter("_gone").select(F.col("id").alias("job_item_id")), "gone-items")
    kept = dict(history)
    kept["post_jobs"] = history["post_jobs"].join(
        gone.withColumnRenamed("job_id", "id"), "id", "left_anti"
    )
    kept["job_items"] = marked.filter("_gone IS NULL").select(*items.columns)
    for child in ("image_assets", "internal_links"):
        kept[child] = skew_join(
            history[child], gone_items, ["job_item_id"], "left_anti", spread_by="id"
        )
    return kept


def failure_patches(errors: DataFrame, items: DataFrame, jobs: DataFrame, seq: Column) -> DataFrame:
    """Errors (blog_url, url, message) as patches that set the post's running items to failed."""
    running = items_of_blogs(items.filter("status = 'running'"), jobs).select(
        "id", "blog_url", F.col("post_url").alias("url")
    )
    broken = running.join(errors.groupBy("blog_url", "url").agg(F.min("message").alias("message")), ["blog_url", "url"])
    set_ = F.explode(
        F.array(
            F.struct(F.lit("status").alias("field"), F.lit("failed").alias("value")),
            F.struct(F.lit("error_message").alias("field"), F.col("message").alias("value")),
        )
    )
    return broken.select("id", seq.cast("bigint").alias("seq"), set_.alias("p")).select("id", "seq", "p.*")


def _facts(table: str, rows: DataFrame, history: dict[str, DataFrame]) -> DataFrame:
    """What one scan of a table says: broken rules, its ids, its references and its unique values."""

    def fact(kind: str, name: str, value: Column, if_: Column) -> Column:
        found = F.struct(
            F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("string").alias("value")
        )
        return F.when(if_, found)

    key, facts = F.col("id"), []
    for column in schemas.NOT_NULL.get(table, ()):
        if column in rows.columns:
            facts.append(fact("broken", f"{column} not null", key, F.col(column).isNull()))
    for owner, column, allowed in schemas.CHECKS:
        if owner == table and column in rows.columns:
            facts.append(fact("broken", f"{column} allowed", key, ~F.col(column).isin(*allowed)))
    for child, column, parent in schemas.FOREIGN_KEYS:
        if child == table and parent in history:
            name = f"{column} refers to {parent}"
            facts.append(fact("reference", name, F.col(column), F.col(column).isNotNull()))
        if parent == table and child in history:
            facts.append(fact("own", f"{column} refers to {parent}", key, key.isNotNull()))
    for owner, column in schemas.UNIQUE:
        if owner == table:
            facts.append(fact("unique", f"{column} unique", F.col(column), F.col(column).isNotNull()))
    found = F.filter(F.array(*facts), lambda f: f.isNotNull())
    return rows.select(F.lit(table).alias("table_name"), "id", F.explode(found).alias("f")).select(
        "table_name", "id", "f.*"
    )


def constraint_violations(history: dict[str, DataFrame]) -> DataFrame:
    """All breaches of NOT NULL, allowed values, foreign keys and uniqueness, as rows.

    `key` is the row's id, or the repeated value for a broken uniqueness; `n` counts its rows. Every
    table is scanned once; what the rules need of it is staged as narrow rows.
    """
    facts = staged(
        reduce(DataFrame.unionByName, [_facts(t, rows, history) for t, rows in history.items()]), "facts"
    )
    breach = ["rule", "table_name", "key", "n"]
    broken = facts.filter("kind = 'broken'").select(
        F.col("name").alias("rule"), "table_name", F.col("value").alias("key"), F.lit(1).cast("bigint").alias("n")
    )
    owned = facts.filter("kind = 'own'").select("name", "value").distinct()
    orphans = skew_join(
        facts.filter("kind = 'reference'"), owned, ["name", "value"], "left_anti", spread_by="id"
    ).select(
        F.col("name").alias("rule"),
        "table_name",
        F.col("id").cast("string").alias("key"),
        F.lit(1).cast("bigint").alias("n"),
    )
    repeated = (
        facts.filter("kind = 'unique'")
        .groupBy(F.col("name").alias("rule"), "table_name", F.col("value").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    return broken.select(breach).unionByName(orphans.select(breach)).unionByName(repeated.select(breach))

"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkferry.operators.skew import staged, staged_rows


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is its smallest node.

    Each round takes the least label among the neighbours and then the label of that label, so chains
    shrink by halves. Neighbours meet in a minimum, never in a list, and every round is written to the
    shared folder, which cuts the lineage.
    """
    once = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    once = staged(once.distinct(), "edges")
    n = 2 * once.count()
    both = once.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        once.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    first = both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    labels = staged_rows(first, n, "labels")
    while n:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("near"))
        )
        met = labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("better")
        )
        jump = labels.select(F.col("node").alias("better"), F.col("label").alias("jumped"))
        best = F.least("better", F.coalesce("jumped", "better"))
        step = met.join(jump, "better", "left").select(
            "node", best.alias("label"), (best < F.col("label")).alias("moved")
        )
        step = staged_rows(step, n, "labels")
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            break
    return labels.withColumnRenamed("label", "component")

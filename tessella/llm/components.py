"""Connected components of an edge table, by labels that travel along edges and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a, b``): the least node that edges reach.

    Each round takes the least label of the neighbours and then the label's own label, so rounds grow with the
    logarithm of a component's diameter. Every round is written to the shared folder, which cuts the lineage.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = written(step.join(jump, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")), "labels")
        moved = new.filter("old <> label").limit(1).count()
        drop_written(labels)
        labels = new.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

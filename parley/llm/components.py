"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) to (node, component): the least node reachable. Nodes without an edge do not appear.

    Each round takes the least label among the neighbours and then the label of that label, so a path of n
    nodes needs about log n rounds. Labels are written each round. Self-loops and repeats are harmless.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "component-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "component-labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = materialise(lower.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("further", "next")).alias("next")), "component-labels")
        if moved.filter("next <> component").limit(1).count() == 0:
            return labels
        labels = moved.select("node", F.col("next").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

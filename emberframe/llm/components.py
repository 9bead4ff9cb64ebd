"""Connected components of a graph given as edges: smallest labels spread over edges, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import written

#: Rounds after which a graph counts as too deep; labels reach 2^n nodes in about n rounds.
MOST_ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label: the smallest node of its component, for every node of edges (a, b); loops and repeated edges do no harm.

    Each round a node takes the smallest label of its neighbours and itself, then the label of that label. Sums combine before
    the shuffle, joins are on a node, and each round is written to the shared folder, so lost executors cost one round at most.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{name}-labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = written(step, f"{name}-step")
        root = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = written(step.join(root, "label", "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")), f"{name}-labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label != old").isEmpty():
            return labels
    raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")

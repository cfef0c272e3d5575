"""Connected components by contraction: hook to the smallest neighbour, jump to the root, relabel the links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from busward.llm.common import staged


def _rooted(parents: DataFrame) -> DataFrame:
    """Pointer jumping: node, root with every root its own parent. Paths halve in each round."""
    while True:
        up = parents.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
        jumped = parents.join(up, F.col("root") == F.col("_at")).select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved"))
        jumped = staged(jumped, "jumped")
        parents = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """node, root for all ends of the links (a, b: longs); root is the smallest node reachable.

    Links stay in Spark; each round at least halves the nodes that still have links between components.
    """
    labels = None
    links = staged(links.filter("a <> b").select("a", "b").distinct(), "links")
    while labels is None or not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
        parents = _rooted(staged(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")), "parents"))
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
            labels = staged(labels.join(up, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_up", "root").alias("root")), "labels")
        first = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        second = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = staged(links.join(first, "a").join(second, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    return labels

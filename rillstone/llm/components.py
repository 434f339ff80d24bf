"""Connected components of a graph given by its edges, as Spark jobs on labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``a, b``, long): the smallest node that can be reached.

    Each round takes the smallest label among neighbours and then the label of the label, so long chains need about as
    many rounds as their length has binary digits. Every round is written to the shared folder; what comes back to the
    driver is one count. Without edges there are no rows.
    """
    both = edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = shared.checkpointed(both.distinct())
    labels = shared.checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("lower"), "component")
        of_label = labels.select(F.col("node").alias("label"), F.col("component").alias("of_label"))
        step = lower.join(of_label, lower.lower == of_label.label, "left")
        step = step.select("node", F.least("lower", F.coalesce("of_label", "lower")).alias("component"), F.col("component").alias("before"))
        step = shared.checkpointed(step)
        labels = step.select("node", "component")
        if step.filter("component <> before").isEmpty():
            return labels

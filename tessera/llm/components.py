"""Connected components by smallest label: neighbours' labels and pointer jumping, each round an aggregate and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b); component is the smallest node reachable.

    Rounds grow with the logarithm of a component's diameter. Self links and repeats do no harm; a null end drops the edge.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    while True:
        labels = materialize(labels, "labels")
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("m")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("m").alias("m"))
        )
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        moved = materialize(
            step.join(jump, "low", "left").select("node", "old", F.least("low", "further").alias("component")), "labels"
        )
        labels = moved.select("node", "component")
        if moved.where("component < old").isEmpty():
            return labels

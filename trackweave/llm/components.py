"""Connected components by label propagation with pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for all nodes of ``edges``; label: the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains
    shrink by more than half a round. Tables are written between rounds; only counts reach the driver.
    """
    # each node's links lead to its smallest neighbour: many links of a dense group become the same few
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    bent = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), "m")
    star = bent.unionByName(least).distinct()
    both = materialise(star.select("u", F.col("m").alias("v")).union(star.select("m", "u")).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = materialise(step.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "far").alias("label")), "labels")
        if new.filter("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")

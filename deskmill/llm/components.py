"""Connected components of an edge table by minimum labels and pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node reachable.

    Every round takes the least label of a node's neighbours and then the label of its label, so
    the rounds grow with the logarithm of the longest path.  Minima are combined before the
    shuffle, and a node with very many edges is split by skew-join handling; a round is kept as
    a table in the shared folder.  Only the count of changes comes to the driver.  No edges give no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("at")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        step = step.join(jump, F.col("label") == F.col("to"), "left").select("node", "old", F.least("label", "further").alias("label"))
        step = checkpoint(step)
        if step.where("label <> old").limit(1).count() == 0:
            return step.select("node", "label")
        labels = step.select("node", "label")

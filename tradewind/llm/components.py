"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of ``links`` (columns a, b; any direction, repeats allowed).

    Each round takes the least label among neighbours and then the label's own label, and writes the
    result, so a lost executor repeats one round at most; ``links`` are read each round, so give a written table. Two one-row counts per round reach the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        heads = lowered.select(F.col("node").alias("label"), F.col("label").alias("head"))
        after = written(lowered.join(heads, "label").select("node", F.least("label", "head").alias("label"), "was"), "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")

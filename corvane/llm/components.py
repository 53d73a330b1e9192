"""Connected components of an edge table by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node that can be reached.

    Labels spread to neighbours and then jump to the label of the label, so that even a chain takes about the
    logarithm of its length in rounds. Each round is written to the shared folder. A node with very many edges is
    summed up before rows move. Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    both = _common.materialize(edges.where("a != b").select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.where("a != b").select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    labels = _common.materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("heard")), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        near = labels.join(told, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = _common.materialize(near.join(jump, "label").select("node", "was", F.least("label", "further").alias("component")), "labels")
        changed = new.where("component != was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels

"""Connected components of an edge table."""
from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that links reach, for every node with a link.

    Labels move to neighbours and then jump to the label of their label, so a chain of n links takes about
    log n rounds. Every round is materialised; joins on a node with many links are split as skewed joins.
    An empty table gives an empty result; a null end is no link.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("component").alias("near"))
        moved = cut_lineage(labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("label")))
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut_lineage(moved.join(jump, "label").select(
            "node", F.col("component").alias("before"), F.least("label", "further").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("before <> component").isEmpty():
            return labels

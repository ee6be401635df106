"""Connected components over an edge table, by label propagation with shortcuts; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import cut_lineage


def label_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) in either direction -> (node, component) for their ends; a component is named by its least node.

    A round takes the least label among a node's neighbours, and then gives every holder of a label the least one that
    any holder of the same label has been offered: holders of one label are in one component, as labels are nodes. That
    is the shortcut that makes the rounds grow with the logarithm of a chain's length. Rounds end when no label changed (labels
    only fall, so that they do end); each is written to the checkpoint folder.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    state = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        offers = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        nearer = cut_lineage(state.join(offers.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "offer").alias("next")))
        seen = cut_lineage(nearer.groupBy(F.col("label").alias("of")).agg(F.min("next").alias("best")).filter("best < of"))
        if seen.isEmpty():
            return state.select("node", F.col("label").alias("component"))
        state = cut_lineage(nearer.join(seen, F.col("label") == F.col("of"), "left").select("node", F.coalesce(F.least("next", "best"), "next").alias("label")))

"""Connected components by hooking and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.tables import discard, settle


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b); label is the smallest node of its component.

    In each round a node takes the least label next to it, so does the node that its label names, and then
    every label is replaced by its own label. Minima are combined before they are shuffled.
    """
    edges = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", narrow=True)
    labels = settle(edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("label")).groupBy("node").agg(F.min("label").alias("label")), "labels", narrow=True)
    while True:
        at_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        at_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        open_edges = edges.join(at_a, "a").join(at_b, "b").where("la <> lb")
        found = open_edges.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), F.least("la", "lb").alias("low")).groupBy("node").agg(F.min("low").alias("low"))
        hooked = settle(labels.join(found, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label")), "hooked", narrow=True)
        over = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = settle(hooked.join(over, "label", "left").select("node", "old", F.coalesce("root", "label").alias("label")), "labels", narrow=True)
        discard(labels, hooked)
        labels = jumped
        if labels.where("old <> label").isEmpty():
            discard(edges)
            return labels.select("node", "label")

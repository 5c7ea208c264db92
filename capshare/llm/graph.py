"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): every node with the smallest node of its component, as (node, label).

    Labels take the smallest label around them, then the label of their label, until nothing changes. Messages
    are pre-aggregated; a node with very many neighbours is spread by the skew join.
    """
    both = settle(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        sent = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("m"))
        met = settle(labels.join(sent, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "met")
        up = met.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = settle(met.join(up, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if not labels.where("old <> label").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark, release, shared_table, since


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of (a, b): label is the smallest node of the component.

    Every round gives each node the smallest label among its neighbours, then
    that label's own label; the rounds end when no label changes, which takes
    about as many as the logarithm of the longest path. Each round is a table in
    the shared folder, and the one before it is deleted. A hub's edges are
    reduced to their least label within map tasks, before they meet.
    """
    spark = edges.sparkSession
    edges = shared_table(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    at = mark()
    labels = shared_table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        before, at = since(at), mark()
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = shared_table(low.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = new.select("node", "label")
        release(spark, before)
        at = mark() - 1
        if new.where("old <> label").isEmpty():
            return labels

"""Program graphs as edge tables: closure, cycles, unused nodes and outputs, tracing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path, by path doubling until nothing is new: about log2 of the longest path rounds. Each round is checkpointed."""
    reach = edges.select("src", "dst").where("src is not null and dst is not null").distinct().checkpoint()
    known = reach.count()
    while True:
        step = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        reach = reach.union(step).distinct().checkpoint()
        if (now := reach.count()) == known:
            return reach
        known = now


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle."""
    return closure(edges).where("src = dst").select(F.col("src").alias("node")).distinct()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that roots (column node) lead to, roots included, by a frontier that shrinks to nothing."""
    links = edges.select("src", "dst").distinct()
    seen = roots.select("node").distinct().checkpoint()
    front = seen
    while not front.isEmpty():
        front = links.join(front, links.src == front.node).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").checkpoint()
        seen = seen.union(front).checkpoint()
    return seen


def unused(nodes: DataFrame, edges: DataFrame, roots: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Nodes that no root leads to and that aren't kept."""
    left = nodes.select("node").join(reachable(edges, roots), "node", "left_anti")
    return left if keep is None else left.join(keep.select("node"), "node", "left_anti")


def unused_outputs(outputs: DataFrame, references: DataFrame) -> DataFrame:
    """Outputs (node, output) that no reference (node, output) names."""
    return outputs.join(references.select("node", "output").distinct(), ["node", "output"], "left_anti")


def trace(edges: DataFrame, node: str, down: bool = True) -> DataFrame:
    """What a node feeds, or what feeds it."""
    spark = edges.sparkSession
    turned = edges.select("src", "dst") if down else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    root = spark.createDataFrame([(node,)], "node string")
    return reachable(turned, root).where(F.col("node") != node)


def equivalent(left: DataFrame, right: DataFrame) -> bool:
    """Whether two programs have the same edges."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()

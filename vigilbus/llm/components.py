"""Connected components of a graph held as an edge table, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilbus.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are hung on the smallest node around it.

    ``edges`` (a, b) have a > b. The minimum of a node is a combined aggregate, joined back by an
    equi-join that Spark splits where a node has very many neighbours.
    """
    if large:
        around = edges.select(F.explode(F.array(
            F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
        ).select("e.*")
    else:
        around = edges
    low = around.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m"))
    hung = around.join(low, around["a"] == low["node"])
    if large:
        return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # The node itself hangs on its minimum, too: the pair (a, m) is among its edges.
    return hung.select(F.explode(F.array(
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of ``edges`` (a, b).

    Runs until all edges are stars around roots; each pass is written to the checkpoint folder.
    """
    edges = cut_lineage(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        hung = _star(edges, True).where("a > b")
        edges = cut_lineage(_star(hung, False).where("a > b").distinct())
        # Stars: every node hangs on one other, which hangs on none.
        state = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
            edges.select("b", F.lit(0), F.lit(1))).groupBy("v").agg(
                F.sum("up").alias("up"), F.max("root").alias("root"))
        if state.where("up > 1 OR (up > 0 AND root > 0)").isEmpty():
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())

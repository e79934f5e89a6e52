"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import join_counted, stored


#: Neighbours from which a node is looked up by broadcast instead of gathered.
HOT_DEGREE = 200_000


def _with_smallest(edges: DataFrame, hot: bool, total: int) -> DataFrame:
    """(u, v) with the smallest node m among u and all its neighbours."""
    if not hot:
        return edges.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    least = edges.groupBy("u").agg(F.min("v").alias("v_min"), F.count(F.lit(1)).alias("n")).select(
        "u", F.least("u", "v_min").alias("m"), "n")
    return join_counted(edges, least, ["u"], "n", total)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, hot: bool, total: int) -> DataFrame:
    """One large-star and one small-star step: every node is linked to the
    smallest node it knows of, and what it was linked to follows."""
    large = (_with_smallest(_both_ways(edges), hot, 2 * total).filter("v > u and v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    found = _with_smallest(large, hot, total)
    small = found.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return small.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs, any direction -> (node, label): the smallest node of
    its component for every node that has an edge.

    Each step is written to the shared folder, so lineage stays short; the number
    of steps grows with the logarithm of the component size.  While a node has
    HOT_DEGREE neighbours or more, no task gathers them.
    """
    edges, mark = stored(edges.select("u", "v").filter("u <> v").distinct(), "cc-edges"), None
    while True:
        degrees = _both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("s"))
        r = degrees.agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        if r.n is None or mark == (r.n, r.s):
            break
        mark = (r.n, r.s)
        edges = stored(_stars(edges, r.most >= HOT_DEGREE, r.n // 2), "cc-edges")
    # Converged: every node points at the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

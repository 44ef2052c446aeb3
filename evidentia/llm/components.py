"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one smaller node at most, which hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    both = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return both.filter((F.col("child") > 1) | (F.col("child") >= 1) & (F.col("parent") == 1)).isEmpty()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours on the smallest of them."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "small")
    return edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs each node's larger neighbours on its smallest neighbour, or on itself if it is smaller."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v), longs; component is its smallest node.

    Rounds of the two stars take turns until only stars are left; their number grows with the logarithm of the longest
    path. A node's minimum is a partial aggregate, and meets the edges in a plain join
    that Spark splits at a node with very many edges. Rounds end in tables of the shared folder.
    Null nodes and loops are no edges; no edges give no rows.
    """
    kept = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    kept, step = written(kept, "edges"), 0
    while not _stars(kept):
        kept = written((_large_star if step % 2 else _small_star)(kept).distinct(), "edges")
        step += 1
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

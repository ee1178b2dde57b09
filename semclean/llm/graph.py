"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the component's smallest node.

    Alternating large-star and small-star steps: each node's larger, then smaller neighbours are tied to
    its smallest one. The edge table never grows, a round is a partial aggregation and a join per step,
    and each round's table is written to the shared folder, so lineage stays short. Rounds end when the
    edges stay the same, after about the logarithm of the longest path.
    """
    pair = F.when(F.col("a") < F.col("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    now = edges.filter(F.col("a") != F.col("b")).select(pair.alias("p")).select("p.a", "p.b").distinct()
    now, seen = materialize(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen:
            break
        seen = mark
        if not mark[0]:
            break
        now = materialize(_small_star(_large_star(now)), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a < b: each node's larger neighbours go to the smallest of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = edges.join(least, "a")
    return moved.select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself go to the smallest of them."""
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"))
    moved = down.join(least, "n").select(F.col("m").alias("a"), F.col("s").alias("b"))
    own = least.select(F.col("m").alias("a"), F.col("n").alias("b"))
    return moved.unionByName(own).filter("a != b").distinct()

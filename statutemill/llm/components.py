"""Connected components by alternating large-star and small-star steps, each a grouping over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours move to its smallest one. Small star: its smaller neighbours and itself do."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = both.groupBy("src").agg(F.min("dst").alias("least")).withColumn("least", F.least("src", "least"))
    joined = both.join(least, "src")
    if large:
        out = joined.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        moved = joined.where(F.col("dst") != F.col("least")).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        out = moved.unionByName(least.select("src", F.col("least").alias("dst")))
    return out.where("src != dst").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for each node of an edge: root is the smallest node reachable.

    edges: (src, dst) longs without nulls, in either direction; self-links and repeats do no harm. Each round's edges are
    written to shared storage, and the loop ends when a round changes nothing.
    """
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src != dst").distinct()
    edges = stored(edges, "components")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head()  # noqa: E731  one row
    seen = mark(edges)
    for _ in range(rounds):
        edges = stored(_star(_star(edges, True), False), "components")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))

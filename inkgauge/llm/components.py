"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node (a > b) hands its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint) that isn't itself the smallest of its component.

    Minima are combined before each shuffle; the links of one node meet in a join by that node, which Spark's adaptive
    execution splits where it is skewed.  A logarithmic number of rounds; each is written to the shared folder and compared by a sum of hashes.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = work.save(edges.filter(F.col("a") != F.col("b")).select(a.alias("a"), b.alias("b")).distinct(), f"{name}0")
    mark, k = None, 0
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or found[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, k = found, k + 1
        now = work.save(_small_star(_large_star(now)), f"{name}{k}")
        if k > 1:
            work.drop(f"{name}{k - 2}")

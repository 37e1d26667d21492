"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import written
from lakeloom.operators.joins import shuffled_again


def _least(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each node; combined before the shuffle, so a hub costs one row a task."""
    return shuffled_again(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), "k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both), F.col("a") == F.col("k"))
    joined = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return joined.where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down), F.col("a") == F.col("k"))
    moved = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.*").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` longs to ``node, root``: every node that has an edge, and the least node it can reach.

    Null ends and loops are ignored; repeated edges do not matter. No edges give no rows. Each round is
    written to the shared folder, so a lost executor costs one round at most. The number of rounds grows with
    the logarithm of the longest path, whatever the size of a component.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        now = written(_small_star(_large_star(now)), "stars")
        mark = now.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark

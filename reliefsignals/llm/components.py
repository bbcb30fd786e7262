"""Connected components of a distributed list of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefsignals.llm.bounds import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _settled(links: DataFrame) -> bool:
    """Whether every node points at one other only, and none that is pointed at points further.

    Both ends are counted per node in one sum, so a node of many links is a few rows from each part.
    """
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.filter("out + into > 1 AND out > 0").isEmpty()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``: the smallest node reachable.

    Each round is written to the shared folder. Rounds end when every node points at the smallest
    node of its component, which one sum shows; another round would give the same links.
    """
    now = written(spark, _small_star(links.filter("a != b").distinct()).distinct(), "links")
    while not _settled(now):
        now = written(spark, _small_star(_large_star(now).distinct()).distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

"""Connected components by alternating star operations: every round is two aggregations and two joins on the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours its smallest neighbour; the result may repeat links."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself the smallest of them; links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    handed = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it can reach) of every node on a link; links: a, b. Nodes without links are absent."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = None
    while True:
        now = written(_small(_large(now)), "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    # at the end all links run to the smallest node of their component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", "b").distinct())

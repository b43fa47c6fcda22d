"""Connected components of a table of links, by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import dropped, written


def _hung(links: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """Hang neighbours on the least node around each node: the larger ones (large star), or the node and its smaller ones (small star).

    The least nodes are a table of their own, so that what they are joined with is dealt for the join alone and Spark splits a star's centre.
    """
    around = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(links.sparkSession, around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", narrow=True)
    joined = around.join(least.hint("merge"), "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct(), least


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (any order, no loops needed) to ``node, component``: the least node that can be reached. Nodes without links don't appear."""
    spark = links.sparkSession
    now = written(spark, links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", narrow=True)
    state = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(sums) == state or not sums[0]:
            break
        state = tuple(sums)
        for small in (False, True):
            hung, least = _hung(now, small)
            now, before = written(spark, hung, "stars", narrow=True), now
            dropped(spark, before, least)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): component is the smallest node that it reaches.

    Alternating large-star and small-star steps: each links a node's neighbours to the least of them, until the edges are
    stars around the least node. Rounds grow with the logarithm of the longest path. Each round is a stored table; the
    driver sees two numbers a round."""
    now = common.staged(spark, edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.staged(spark, large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = common.staged(spark, small.select("v", "u"), "small-star")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        common.drop_staged(spark, now, large)
        now = after
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = seen

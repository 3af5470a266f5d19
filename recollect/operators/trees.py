"""Tree search in rounds, many trees at once: select, expand, evaluate, propagate back. A round is a plan over all trees; the nodes are stored after each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.sources import staging

EXPLORE, UNSCORED = 1.414, 50.0


def uct(score: Column, visits: Column, above: Column) -> Column:
    """Value of a child; endless for one that wasn't visited."""
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(F.coalesce(score, F.lit(UNSCORED)) / 100 + EXPLORE * F.sqrt(F.ln(F.greatest(above, F.lit(1))) / visits))


def descended(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """One level down to the best child, the first of equal ones; a node without children stays."""
    kids = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node"), F.col("node").alias("kid"), "score", F.col("visits").alias("n"))
    met = at.join(kids, ["tree", "node"], "left").withColumn("value", F.when(F.col("kid").isNotNull(), uct(F.col("score"), F.col("n"), F.col("visits"))))
    best = met.groupBy("tree", "node", "path", "visits").agg(F.max_by(F.struct("kid", "n"), F.struct("value", -F.col("kid"))).alias("b"))
    down = F.col("b.kid").isNotNull()
    return best.select("tree", F.when(down, F.col("b.kid")).otherwise(F.col("node")).alias("node"), F.when(down, F.array_append("path", F.col("b.kid"))).otherwise(F.col("path")).alias("path"), F.when(down, F.col("b.n")).otherwise(F.col("visits")).alias("visits"))


def searched(roots: DataFrame, rounds: int, width: int, score: Callable[[Column, Column], Column]) -> DataFrame:
    """tree, node, parent, score, visits after some rounds. roots: tree. A root is node 0; the children of node n are n * width + 1 and on. In a round each tree goes down by
    the greatest value to a node without children; a visited one (or the root) gets `width` children with their scores, of which the first is taken; what was
    reached and all above it count a visit."""
    nodes = roots.select("tree", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(UNSCORED).alias("score"), F.lit(0).cast("long").alias("visits"))
    nodes = staging.staged(nodes, "trees")
    for k in range(rounds):
        at = nodes.where("node = 0").select("tree", "node", F.array("node").alias("path"), "visits")
        for _ in range(k):  # no tree is deeper than its rounds
            at = descended(nodes, at)
        at = staging.staged(at, "reached")
        grown = at.where("visits > 0 OR node = 0")
        new = grown.select("tree", F.explode(F.sequence(F.col("node") * width + 1, F.col("node") * width + width)).alias("node"), F.col("node").alias("parent"))
        new = new.select("tree", "node", "parent", score(F.col("tree"), F.col("node")).cast("double").alias("score"), F.lit(0).cast("long").alias("visits"))
        ends = F.when((F.col("visits") > 0) | (F.col("node") == 0), F.array_append("path", F.col("node") * width + 1)).otherwise(F.col("path"))
        seen = at.select("tree", F.explode(ends).alias("node"), F.lit(1).alias("one"))
        both = nodes.unionByName(new).join(seen, ["tree", "node"], "left")
        nodes = staging.staged(both.select("tree", "node", "parent", "score", (F.col("visits") + F.coalesce("one", F.lit(0))).alias("visits")), "trees")
    return nodes

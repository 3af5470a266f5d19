"""Graph operators as rounds of joins. Rounds are bounded by a depth, or by a number that the driver reads after each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import folds
from recollect.sources import staging


def activated(edges: DataFrame, matched: DataFrame, attenuation: float) -> DataFrame:
    """(id, activation): nodes at the other end of edges (src, dst, confidence) of matched ids; the surest edge counts."""
    sure = F.coalesce("confidence", F.lit(1.0)).alias("confidence")
    there = edges.join(matched, edges["src"] == matched["id"], "left_semi").select(F.col("dst").alias("id"), sure)
    back = edges.join(matched, edges["dst"] == matched["id"], "left_semi").select(F.col("src").alias("id"), sure)
    return there.unionByName(back).groupBy("id").agg((F.max("confidence") * attenuation).alias("activation"))


def traversed(edges: DataFrame, start: DataFrame, depth: int = 3, relation: str | None = None, as_of: Column | None = None, each: int = 50, most: int = 1000) -> DataFrame:
    """(start, node, confidence, hops): nodes reached from each start (id) over out edges (src, dst, confidence, perhaps relation,
    valid_from, valid_to), by the path of the greatest product of confidences; a node goes on only if that grew. At most `each` edges a
    node, and `most` hits a start, the nearest and surest ones."""
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    if as_of is not None:
        edges = edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))
    steps = folds.first_of_each(edges.select("src", "dst", F.coalesce("confidence", F.lit(1.0)).alias("sure")), ["src"], each, "dst", F.desc("sure")).drop("k")
    known = start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(1.0).alias("confidence"), F.lit(0).alias("hops"))
    front = known
    for hop in range(1, depth + 1):
        reached = front.join(steps, front["node"] == steps["src"]).select("start", F.col("dst").alias("node"), (F.col("confidence") * F.col("sure")).alias("confidence"), F.lit(hop).alias("hops"))
        both = known.unionByName(reached)
        known = both.groupBy("start", "node").agg(F.max(F.struct("confidence", (-F.col("hops")).alias("h"))).alias("b")).select("start", "node", "b.confidence", (-F.col("b.h")).alias("hops"))
        known = staging.staged(known, "reached") if hop < depth else known
        front = known.where(F.col("hops") == hop)
    return folds.first_of_each(known.where("hops > 0"), ["start"], most, "hops", F.desc("confidence"), "node").drop("k")


def expanded(primary: DataFrame, followed: DataFrame, nodes: DataFrame, cue: str, depth: float, scopes: list[str], each: int = 10) -> DataFrame:
    """(id, score): neighbours in time of primary rows (id, score), up to three hops before or behind by the cue, each at half the score of
    the one before; only rows of the scopes and of the same user (no user meets no user). nodes: id, prefix, scope. The best score of a
    node counts. A relative cue looks nowhere."""
    empty = primary.select("id", "score").limit(0)
    if cue == "relative":
        return empty
    a, b = ("dst", "src") if cue in ("preceding", "procedural") else ("src", "dst")
    steps = folds.first_of_each(followed, [a], each, b).select(F.col(a).alias("here"), F.col(b).alias("there"))
    of = nodes.select(F.col("id").alias("there"), F.col("prefix").alias("there_prefix"), F.col("scope").alias("there_scope"))
    front = primary.join(nodes.select("id", "prefix"), "id", "left").select(F.col("id").alias("at"), "score", "prefix")
    out = empty
    for _ in range(max(1, min(3, round(depth)))):
        front = front.join(steps, front["at"] == steps["here"]).select(F.col("there").alias("at"), (F.col("score") * 0.5).alias("score"), "prefix")
        seen = front.join(of, front["at"] == of["there"]).where(F.col("prefix").eqNullSafe(F.col("there_prefix")) & F.coalesce("there_scope", F.lit("general")).isin([*scopes, "general"]))
        out = out.unionByName(seen.select(F.col("at").alias("id"), "score"))
    return out.groupBy("id").agg(F.max("score").alias("score"))


def anchors(names: list[DataFrame], near: DataFrame, most: int = 5) -> DataFrame:
    """(id, weight): at most `most` anchors. Lists of exact matches (id) come first, in turn, with weight 1; then the nearest ones (id,
    similarity), with one minus the similarity, between 0 and 1."""
    from pyspark.sql.window import Window

    lists = [n.select("id", F.lit(i).alias("list"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("order")).orderBy("id").limit(most) for i, n in enumerate(names)]
    fill = near.orderBy(F.desc("similarity"), "id").limit(most).select("id", F.lit(len(names)).alias("list"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("similarity"))).alias("weight"), (-F.col("similarity")).alias("order"))
    rows = fill
    for other in lists:
        rows = rows.unionByName(other)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("list", "order"))).where("k = 1")  # some lists of `most`
    return first.orderBy("list", "order", "id").limit(most).select("id", "weight")


def ancestors(parents: DataFrame, most: int = 64) -> DataFrame:
    """(node, ancestor, steps) of a forest of (node, parent); a root's parent is null. A round a level."""
    known = parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    front, out = staging.staged(known, "level"), None
    up = parents.where("parent IS NOT NULL").select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    for _ in range(most):
        out = front if out is None else out.unionByName(front)
        front = staging.staged(front.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("steps") + 1).alias("steps")), "level")
        if front.isEmpty():
            return out
    raise ValueError(f"a path of more than {most} parents: not a forest?")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """Uniform start, fixed rounds, repeated edges count, dangling mass leaks. edges: src, dst. Edges with their weight and the nodes are
    stored once, ranks after some rounds."""
    weights = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = staging.staged(weights.join(out, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share")), "links")
    nodes = staging.staged(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct(), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for k in range(rounds):
        sent = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(sent, nodes["node"] == sent["dst"], "left").select("node", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % every == every - 1 and k < rounds - 1:
            ranks = staging.staged(ranks, "ranks")
    return ranks


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of every node (id): the least id that edges (a, b) lead to. Labels are passed on, and then the label of the label, so
    rounds grow with the logarithm of a path's length."""
    both = staging.staged(edges.select("a", "b").union(edges.select("b", "a")), "both")
    labels = staging.staged(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        told = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("heard", "component")).alias("component"), F.col("component").alias("was"))
        of = told.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = staging.staged(told.join(of, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "was"), "labels")
        changed = after.where("component <> was").isEmpty()
        labels = after.select("id", "component")
        if changed:
            return labels


def greedy_clusters(pairs: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(id, cluster): in order of id, a row that no earlier cluster has takes all later free rows that it is paired with (a, b). Clusters
    under `least` rows are dropped. The seeds are the first maximal independent set: a row is one as soon as none of the rows before
    it that it is paired with can be, and is none once one of them is. Rounds are few, as each decides all rows whose turn it is."""
    before = staging.staged(pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "pairs")
    state = staging.staged(nodes.select("id", F.lit(0).alias("seed")), "seeds")  # 0 open, 1 seed, 2 taken
    while True:
        told = before.join(state.select(F.col("id").alias("low"), F.col("seed").alias("s")), "low").groupBy(F.col("high").alias("id")).agg(F.max((F.col("s") == 1).cast("int")).alias("near"), F.max((F.col("s") == 0).cast("int")).alias("open"))
        now = F.when(F.col("seed") > 0, F.col("seed")).when(F.col("near") == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = staging.staged(state.join(told, "id", "left").select("id", now.alias("seed")), "seeds")
        if state.where("seed = 0").isEmpty():
            break
    seeds = state.where("seed = 1").select(F.col("id").alias("low"))
    taken = before.join(seeds, "low").groupBy(F.col("high").alias("id")).agg(F.min("low").alias("cluster"))
    members = state.join(taken, "id", "left").select("id", F.when(F.col("seed") == 1, F.col("id")).otherwise(F.col("cluster")).alias("cluster"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return members.join(sizes, "cluster").select("id", "cluster")

"""Hybrid search, the composite operator: candidates by vector and keyword from episodes, insights and rules, one score, and what follows it.

Everything up to the pools is a plan over whole tables; the pools are bounded (50 a table by vector, 200 by keyword), and what depends on
the order of a result list is folded over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import columns as c
from recollect.functions import texts, words
from recollect.operators import folds, graphs
from recollect.plans.registry import Tables, query
from recollect.plans.retrieval import bm25, corpus, counted, idf, sentence_cosine, total
from recollect.sources import staging

# How much importance and recency weigh in each table, and each class' bonus of the first ranks.
WEIGHTS = {"episode": ("session", 0.3, 0.3), "wiki": ("project", 0.4, 0.2), "rule": ("wisdom", 0.5, 0.1)}
LADDER = {"Temporal": 0.3605, "Preference": 0.2852, "User": 0.1333, "Default": 0.15}
FIRST_RANKS = (0.15, 0.10, 0.06, 0.03, 0.01)
FIELDS = ["id", "kind", "title", "content", "session_id", "scope", "vault_path", "confidence"]


@dataclass(frozen=True)
class Request:
    """A search. `vector`: the query's embedding, None for keywords alone."""

    query: str
    vector: list[float] | None
    anchor: str
    scope: str = "general"
    session: str | None = None
    limit: int = 15
    offset: int = 0
    threshold: float = 0.55
    everywhere: bool = False
    include_archived: bool = False
    include_artifacts: bool = False
    keep_logs: bool = False
    token_budget: int | None = None
    hybrid: bool = True
    sigma_hours: float = 375.0
    decay_floor: float = 0.0
    rerank: float = 0.1
    rerank_pool: int = 20
    session_boost: float = 0.3556
    gate: tuple[float, float] = (20.0, 0.6)
    pools: dict[str, int] = field(default_factory=lambda: {"vector": 50, "keyword": 200, "expanded": 8, "promoted": 75})


@dataclass(frozen=True)
class Prepared:
    category: str
    cue: str | None
    depth: float
    cleaned: str
    terms: tuple[str, ...]
    prefix: str | None


def prepare(spark, r: Request) -> Prepared:
    """Class, cue and words of a query: one row, on the driver."""
    q = F.lit(r.query)
    cue = c.temporal_cue(q)
    prefix = c.user_prefix(F.lit(r.session)) if r.session else F.lit(None).cast("string")
    clean = F.when(cue["kind"].isNotNull() & F.lit(r.hybrid), c.without_temporal(q)).otherwise(q)
    row = spark.range(1).select(c.category(q).alias("category"), cue["kind"].alias("kind"), cue["depth"].alias("depth"), clean.alias("clean"), F.array_distinct(c.search_words(clean)).alias("terms"), prefix.alias("prefix")).first()
    return Prepared(row["category"], row["kind"] if r.hybrid else None, row["depth"] or 0.0, row["clean"], tuple(row["terms"]), row["prefix"])


def visible(rows: DataFrame, kind: str, r: Request, p: Prepared) -> DataFrame:
    test = F.lit(True) if r.everywhere else F.col("scope").isin(r.scope, "general")
    if not r.keep_logs:
        test &= ~F.coalesce(F.col("node_type").isin("tool_execution", "system_log", "handoff_event"), F.lit(False))
    if not r.include_artifacts:
        test &= F.col("vault_path").isNull() | ~F.col("vault_path").contains("wiki/artifacts/")
    if kind == "episode" and not r.include_archived:
        test &= ~F.coalesce("archived", F.lit(False))
    if kind == "episode" and p.prefix:
        test &= F.col("session_id").isNull() | F.col("session_id").startswith(p.prefix)
    return rows.where(test & (F.coalesce("status", F.lit("active")) != "superseded"))


def factor(kind: str, r: Request, p: Prepared, sim: Column) -> Column:
    """Importance and recency, the tier's boost, and what an archived row loses."""
    tier, importance, recency = WEIGHTS[kind]
    sigma = 1e6 if p.category == "Temporal" and p.cue in ("preceding", "succeeding", "procedural") else r.sigma_hours
    hours = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(r.anchor).cast("timestamp")) - F.unix_timestamp("aged_at")) / 3600)
    fresh = F.lit(1.0) if p.category in ("Preference", "User") or sigma <= 0 else F.greatest(F.exp(-0.5 * F.pow(hours / sigma, 2)), F.lit(r.decay_floor))
    blend = (importance * F.col("importance") + recency * F.coalesce(fresh, F.lit(1.0))) / (importance + recency)
    same = c.user_prefix(F.col("session_id")) == F.lit(p.prefix) if p.prefix else F.lit(False)
    demoted = F.when(F.coalesce("archived", F.lit(False)) & ~F.coalesce(same & (sim >= 0.8), F.lit(False)), 0.4).otherwise(1.0)
    return blend * c.tier_boost(F.lit(tier), F.lit(p.category)) * demoted


def scored(rows: DataFrame, kind: str, path: str, r: Request, p: Prepared) -> DataFrame:
    """Rows of a pool (with `dot` and `place` in it) with raw similarity and factor, over the path's share of the threshold."""
    rung = F.coalesce(F.get(F.array(*(F.lit(x) for x in FIRST_RANKS)), F.col("place") - 1), F.lit(0.0))
    turn = c.turn_number(F.col("title")) if kind == "episode" else F.lit(None).cast("long")
    boost = LADDER[p.category] * F.when(turn.isNotNull(), F.greatest(F.lit(0.0), 1 - turn / 10.0)).otherwise(rung)
    raw = F.col("dot") + boost
    rows = rows.withColumn("raw", raw if kind == "episode" else F.least(F.lit(1.0), raw))
    rows = rows.withColumn("factor", factor(kind, r, p, F.col("raw")))
    bar = r.threshold * (0.5 if path == "vector" else 0.7)
    return rows.where(F.col("raw") * F.col("factor") >= bar).select(*FIELDS, "raw", "factor", "bm25")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Places in a pool of a bounded size."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def candidates(tables: dict[str, DataFrame], r: Request, p: Prepared) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(by vector, by keyword, the corpus' numbers for the terms)."""
    near, told = [], []
    n = len(p.terms)
    for kind in WEIGHTS:
        rows = visible(tables[kind], kind, r, p).withColumn("kind", F.lit(kind)).withColumn("content", F.coalesce("content", F.lit("")))
        if r.vector is not None:
            q = F.array(*(F.lit(float(x)) for x in r.vector))
            dot = F.aggregate(F.zip_with("embedding", q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
            rows = rows.withColumn("dot", F.coalesce(dot, F.lit(1.0)))
            order = (F.round("dot", 9).desc(), F.col("id"))
            pool = numbered(rows.where("embedding IS NOT NULL").orderBy(*order).limit(r.pools["vector"]), *order)
            near.append(scored(pool.withColumn("bm25", F.lit(None).cast("double")), kind, "vector", r, p))
        else:
            rows = rows.withColumn("dot", F.lit(1.0))
        if kind == "episode":
            numbers = corpus(counted(rows, "id", "content", p.terms), n)
            if n:
                found = bm25(rows, "id", "content", p.terms).select("id", "bm25")
                best = found.orderBy(F.round("bm25", 9).desc(), "id").limit(r.pools["keyword"])
                met = rows.join(F.broadcast(best), "id")
            else:
                met = rows.where(F.col("title").contains(p.cleaned)).orderBy("id").limit(r.pools["keyword"]).withColumn("bm25", F.lit(0.0))
            told.append(scored(numbered(met, F.round("bm25", 9).desc(), F.col("id")), kind, "keyword", r, p))
        else:
            met = rows.where(F.col("content").contains(p.cleaned) | F.col("title").contains(p.cleaned)).orderBy("id").limit(r.pools["keyword"])
            told.append(scored(numbered(met, F.col("id")).withColumn("bm25", F.lit(None).cast("double")), kind, "keyword", r, p))
    union = lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union(near) if near else None, union(told), numbers


def fused(near: DataFrame | None, told: DataFrame, numbers: DataFrame, r: Request, p: Prepared) -> DataFrame:
    """One row an id with its score. The vector side's fields count; the keyword side gives its bm25."""
    if near is None:
        both = told.withColumn("raw", F.lit(1.0))
    else:
        k = told.select(*(F.col(x).alias(f"k_{x}") for x in told.columns))
        met = near.join(k, near["id"] == k["k_id"], "full_outer")
        keep = [F.when(F.col("id").isNotNull(), F.col(x)).otherwise(F.col(f"k_{x}")).alias(x) for x in (*FIELDS, "raw", "factor")]
        both = met.select(*keep, F.col("k_bm25").alias("bm25"))
    both = staging.staged(both.withColumn("bm25", F.coalesce("bm25", F.lit(0.0))), "candidates")
    ends = both.agg(F.min("bm25").alias("low"), F.max("bm25").alias("high"))
    n = len(p.terms)
    rarity = total([idf(i) for i in range(n)]) / n if n else F.lit(0.0)
    beta = F.least(F.lit(0.8), 0.2 + 0.15 * F.greatest(F.lit(0.0), rarity - 2.5)) if n else F.lit(0.2)
    rows = both.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(numbers.select(beta.alias("beta"))))
    span = F.col("high") - F.col("low")
    keyword = F.when(span > 1e-6, (F.col("bm25") - F.col("low")) / span).when(F.col("high") > 1e-6, 1.0).otherwise(0.0)
    mixed = (1 - F.col("beta")) * F.col("raw") + F.col("beta") * keyword
    steep, centre = r.gate
    return rows.withColumn("fused", mixed).select(*FIELDS, (F.col("fused") * F.col("factor") / (1 + F.exp(-steep * (F.col("fused") - centre)))).alias("score"))


def isolated(rows: DataFrame, p: Prepared) -> DataFrame:
    """Rows without a session and the user's. Where no session was given, the best row that has one decides on the user."""
    own = c.user_prefix(F.col("session_id"))
    if p.prefix:
        return rows.where(F.col("session_id").isNull() | (own == p.prefix))
    first = rows.where("session_id IS NOT NULL").orderBy(F.round("score", 9).desc(), "id").limit(1).select(own.alias("user"))
    return rows.join(F.broadcast(first), F.lit(True), "left").where(F.col("session_id").isNull() | F.col("user").isNull() | (own == F.col("user"))).drop("user")


def expanded(rows: DataFrame, tables: dict[str, DataFrame], r: Request, p: Prepared) -> DataFrame:
    """With the best rows' neighbours in time, at the better of their scores."""
    if p.cue is None:
        return rows
    episodes = tables["episode"]
    nodes = episodes.select("id", c.user_prefix(F.col("session_id")).alias("prefix"), "scope")
    primary = rows.orderBy(F.round("score", 9).desc(), "id").limit(r.pools["expanded"]).select("id", "score")
    near = staging.staged(graphs.expanded(primary, tables["followed"], nodes, p.cue, p.depth, [r.scope]).withColumnRenamed("score", "near"), "neighbours")
    met = rows.join(near, "id", "left").withColumn("score", F.greatest("score", F.coalesce("near", "score"))).drop("near")
    new = episodes.withColumn("kind", F.lit("episode")).join(F.broadcast(near), "id").join(rows.select("id"), "id", "left_anti")
    return met.unionByName(new.select(*FIELDS, F.col("near").alias("score")))


def search(tables: dict[str, DataFrame], r: Request) -> DataFrame:
    """A page of results: id, tier, title, content, score, place, total, has_more, next_offset, omitted. tables: `episode`, `wiki` and `rule`
    (id, title, content, session_id, scope, vault_path, archived, status, node_type, importance, aged_at, confidence, embedding),
    `followed` and `relates` (src, dst). importance is the share of a score, so it is divided beforehand."""
    spark = tables["episode"].sparkSession
    p = prepare(spark, r)
    near, told, numbers = candidates(tables, r, p)
    rows = expanded(staging.staged(isolated(fused(near, told, numbers, r, p), p), "scored"), tables, r, p)
    n = len(p.terms)
    if r.rerank > 0 and n and r.hybrid:
        pool = rows.orderBy(F.round("score", 9).desc(), "id").limit(max(20, r.rerank_pool)).crossJoin(F.broadcast(numbers.select(*(idf(i).alias(f"idf{i}") for i in range(n)))))
        cosine = sentence_cosine(pool, "id", "content", p.terms)
        rows = rows.join(F.broadcast(cosine), "id", "left").withColumn("score", F.col("score") + r.rerank * F.coalesce("cosine", F.lit(0.0))).drop("cosine")
    if p.prefix:
        same = F.coalesce(c.user_prefix(F.col("session_id")) == p.prefix, F.lit(False))
        rows = rows.withColumn("score", F.col("score") + F.when(same, r.session_boost).otherwise(0.0))
    rows = staging.staged(rows, "ranked")
    ids = rows.select(F.col("id").alias("src"))
    first = folds.first_of_each(tables["relates"].join(F.broadcast(ids), "src", "left_semi"), ["src"], 10, "dst")
    related = first.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("related"))
    tier = c.first_match([(F.col("kind") == k, F.lit(t)) for k, (t, _, _) in WEIGHTS.items()], F.lit(None))
    listed = rows.join(F.broadcast(related), "id", "left").withColumn("tier", tier)
    listed = listed.withColumn("hierarchy", c.hierarchy(F.col("tier"), F.col("vault_path"), F.col("title"))).withColumn("content", F.substring("content", 1, 10_000))
    page = lambda pdf: finished(pdf, r)
    shape = "id string, tier string, title string, content string, score double, place int, total int, has_more boolean, next_offset int, omitted int"
    return listed.select("id", "tier", "title", "content", "session_id", "confidence", "score", "hierarchy", "related").groupBy().applyInPandas(page, shape)


def finished(pdf: pd.DataFrame, r: Request) -> pd.DataFrame:
    """Promotion, confidence, relations, budget and page of a result list, in that order."""
    best = lambda f: f.assign(_s=f["score"].round(9)).sort_values(["_s", "id"], ascending=[False, True]).drop(columns="_s")
    rows = folds.promoted(best(pdf), r.pools["promoted"])
    rows = rows.assign(score=rows["score"] * rows["confidence"].astype(float).fillna(1.0).where(rows["tier"] == "session", 1.0))
    rows = best(rows).head(5 * r.limit)
    seen, kept = set(), []
    for row in rows.itertuples():
        if row.id not in seen:
            seen.update(row.related if row.related is not None else [])
            kept.append(row.id)
    rows = rows[rows["id"].isin(kept)]
    omitted = 0
    if r.token_budget is not None:
        rows, left, fits = best(rows).sort_values("hierarchy", kind="stable"), r.token_budget, []
        for row in rows.itertuples():
            need = texts.token_estimate(f"{row.title}\n{row.content}")
            head = texts.token_estimate(f"{row.title}\n")
            content = row.content if need <= left else texts.compacted(row.content, left - head) if head < left else None
            if content is None:
                omitted += 1
                continue
            left -= min(need, texts.token_estimate(f"{row.title}\n{content}"))
            fits.append((row.id, content))
        rows = rows[rows["id"].isin([i for i, _ in fits])].assign(content=[x for _, x in fits])
    every = len(rows) + omitted
    page = rows.iloc[r.offset : r.offset + r.limit]
    page = page.assign(place=range(r.offset + 1, r.offset + len(page) + 1), total=every, has_more=every > r.offset + r.limit, next_offset=r.offset + r.limit, omitted=omitted)
    return page[["id", "tier", "title", "content", "score", "place", "total", "has_more", "next_offset", "omitted"]].astype(dict.fromkeys(["id", "tier", "title", "content"], object))


# The tables as a memory: turns are episodes, documents insights, benchmark items rules; ids choose the vectors.


def memory(t: Tables) -> dict[str, DataFrame]:
    vec = t("embeddings").select((F.col("vec_id")).alias("vec"), "embedding")
    k, n = F.col("conv_id"), F.col("turn")
    none = lambda kind: F.lit(None).cast(kind)
    at = lambda day, hours: F.lit(day).cast("timestamp") + F.make_interval(hours=hours.cast("int"))
    episode = t("conversations").select(
        F.concat(F.lit("episode:"), k, F.lit("_"), n).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("Session s - Turn "), n)).otherwise(F.concat(F.lit("Note "), k, F.lit("."), n)).alias("title"), F.col("text").alias("content"),
        F.when(k % 4 > 0, F.concat(F.lit("u"), k % 5, F.lit("_"), k % 100)).alias("session_id"), F.when(k % 3 == 0, "general").when(k % 7 == 5, "src2").otherwise("src1").alias("scope"), none("string").alias("vault_path"),
        (k % 11 == 0).alias("archived"), F.lit("active").alias("status"), F.when(F.col("role") == "system", "system_log").otherwise("agent_thought").alias("node_type"), ((1 + (k + n) % 10) / 10.0).alias("importance"),
        at("2024-01-01", k % 700).alias("aged_at"), (0.5 + n % 5 / 10.0).alias("confidence"), ((k * 8 + n) % 500).alias("vec"),
    )
    d = F.col("doc_id")
    wiki = t("documents").select(
        F.concat(F.lit("wiki_node:"), d).alias("id"), F.concat("source", F.lit(" "), d).alias("title"), F.col("text").alias("content"), none("string").alias("session_id"), F.when(d % 2 == 0, "general").otherwise(F.col("source")).alias("scope"),
        F.when(d % 4 == 0, "x/wiki/artifacts/y").alias("vault_path"), F.lit(False).alias("archived"), F.lit("active").alias("status"), F.when(d % 6 == 0, "tool_execution").otherwise("insight").alias("node_type"), F.lit(5.0).alias("importance"),
        at("2023-11-01", d % 900).alias("aged_at"), none("double").alias("confidence"), (d % 500).alias("vec"),
    )
    i = F.col("item_id")
    rule = t("benchmark").select(
        F.concat(F.lit("wisdom:"), i).alias("id"), F.concat(F.lit("Rule "), i).alias("title"), F.col("text").alias("content"), none("string").alias("session_id"), F.lit("general").alias("scope"), none("string").alias("vault_path"),
        F.lit(False).alias("archived"), F.when(i % 9 == 0, "superseded").otherwise("active").alias("status"), F.lit("rule").alias("node_type"), (i % 101 / 100.0).alias("importance"), at("2023-12-01", i).alias("aged_at"),
        none("double").alias("confidence"), (i * 3 % 500).alias("vec"),
    )
    followed = t("conversations").select(F.concat(F.lit("episode:"), k, F.lit("_"), n).alias("src"), F.lead(F.concat(F.lit("episode:"), k, F.lit("_"), n)).over(Window.partitionBy("conv_id").orderBy("turn")).alias("dst")).where("dst IS NOT NULL")
    relates = t("conversations").select(F.concat(F.lit("episode:"), k, F.lit("_"), n).alias("src"), F.concat(F.lit("wiki_node:"), (k * 8 + n) % 300).alias("dst"))
    vectors = F.broadcast(vec) if vec.count() <= 1 << 16 else vec
    return {name: rows.join(vectors, "vec", "left").drop("vec") for name, rows in (("episode", episode), ("wiki", wiki), ("rule", rule))} | {"followed": followed, "relates": relates}


def asked(t: Tables, **more) -> Request:
    vector = t("embeddings").where("vec_id = 0").first()["embedding"]
    return Request(**{"query": "thnd before ering oner", "vector": [float(x) for x in vector], "anchor": "2024-02-01 00:00:00", "scope": "src1", "session": "u3_3"} | more)


STOPS = ", ".join(f"'{w}'" for w in words.STOP_WORDS)
SEARCH_SQL = rf"""WITH ep AS (SELECT 'episode:' || conv_id || '_' || turn AS id, 'episode' AS kind, CASE WHEN conv_id % 2 = 0 THEN 'Session s - Turn ' || turn
  ELSE 'Note ' || conv_id || '.' || turn END AS title, coalesce(text, '') AS content, CASE
  WHEN conv_id % 4 > 0 THEN 'u' || (conv_id % 5) || '_' || (conv_id % 100) END AS session_id,
  CASE WHEN conv_id % 3 = 0 THEN 'general' WHEN conv_id % 7 = 5 THEN 'src2' ELSE 'src1' END AS scope, CASE
  WHEN conv_id % 4 > 0 THEN 'u' || (conv_id % 5) END AS prefix, conv_id % 11 = 0 AS archived, role = 'system' AS log, (1 + (conv_id + turn) % 10) / 10e0 AS importance, 0.5e0 + (turn % 5) / 10e0 AS confidence, (conv_id * 8 + turn) % 500 AS vec, conv_id, turn,
  epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(TIMESTAMP '2024-01-01 00:00:00') - (conv_id % 700) * 3600 AS age FROM conversations),
every AS (SELECT id, kind, title, content, session_id, prefix, importance, confidence, vec, CASE WHEN conv_id % 2 = 0 THEN turn END AS turn, age
  FROM ep WHERE scope IN ('src1', 'general') AND NOT archived AND NOT log AND (session_id IS NULL OR starts_with(session_id, 'u3'))
 UNION ALL SELECT 'wiki_node:' || doc_id, 'wiki', source || ' ' || doc_id,
  coalesce(text, ''), NULL, NULL, 5e0, NULL, doc_id % 500, NULL, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(TIMESTAMP '2023-11-01 00:00:00') - (doc_id % 900) * 3600 FROM documents WHERE (doc_id % 2 = 0 OR source = 'src1') AND doc_id % 4 > 0 AND doc_id % 6 > 0
 UNION ALL SELECT 'wisdom:' || item_id, 'rule', 'Rule ' || item_id,
  coalesce(text, ''), NULL, NULL, (item_id % 101) / 100e0, NULL, item_id * 3 % 500, NULL, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(TIMESTAMP '2023-12-01 00:00:00') - item_id * 3600 FROM benchmark WHERE item_id % 9 > 0),
vis AS (SELECT v.*, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS dot FROM every v
  JOIN embeddings e ON e.vec_id = v.vec, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
toks AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}-]+'), lambda x: x <> '' AND x NOT IN ({STOPS}))) AS term FROM vis WHERE kind = 'episode'), lens AS (SELECT id, count(*) AS dl FROM toks GROUP BY id),
stat AS (SELECT (SELECT count(*) FROM vis WHERE kind = 'episode') AS n, (SELECT sum(dl) FROM lens) / (SELECT count(*) FROM vis
  WHERE kind = 'episode') AS avgdl), tf AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN ('thnd', 'ering', 'oner') GROUP BY id, term),
terms AS (SELECT w.term, ln((n - count(tf.id) + 0.5e0) / (count(tf.id) + 0.5e0) + 1) AS idf FROM (VALUES ('thnd'), ('ering'), ('oner')) w(term) CROSS
  JOIN stat LEFT JOIN tf ON tf.term = w.term GROUP BY w.term, n),
bm AS (SELECT tf.id, sum(idf * tf * 2.2e0 / (tf + 1.2e0 * (0.4e0 + 0.6e0 * dl / avgdl))) AS bm25 FROM tf JOIN terms ON terms.term = tf.term
  JOIN lens ON lens.id = tf.id CROSS JOIN stat GROUP BY tf.id),
pool AS (SELECT 'v' AS path, *, CAST(NULL AS DOUBLE) AS bm25, row_number() OVER (PARTITION BY kind ORDER BY round(dot, 9) DESC, id) AS place FROM vis
  QUALIFY place <= 50
 UNION ALL SELECT 'k', vis.*, bm.bm25, row_number() OVER (ORDER BY round(bm.bm25, 9) DESC, vis.id) AS place FROM vis JOIN bm ON bm.id = vis.id
  QUALIFY place <= 200
 UNION ALL SELECT 'k', *, NULL, row_number() OVER (PARTITION BY kind ORDER BY id) AS place FROM vis
  WHERE kind <> 'episode' AND (contains(content, 'thnd ering oner') OR contains(title, 'thnd ering oner')) QUALIFY place <= 200),
raw AS (SELECT *, CASE WHEN kind = 'episode' THEN dot + 0.3605e0 * step ELSE least(1e0, dot + 0.3605e0 * step) END AS raw FROM (SELECT *, CASE
  WHEN turn IS NOT NULL THEN greatest(0e0, 1 - turn / 10e0) ELSE coalesce([0.15e0, 0.10e0, 0.06e0, 0.03e0, 0.01e0][place], 0) END AS step
  FROM pool) x),
fac AS (SELECT *, CASE kind WHEN 'episode' THEN (0.3e0 * importance + 0.3e0 * rec) / 0.6e0 * 1.3e0
  WHEN 'wiki' THEN (0.4e0 * importance + 0.2e0 * rec) / 0.6e0 * 1.1e0 ELSE (0.5e0 * importance + 0.1e0 * rec) / 0.6e0 * 1.2e0 END AS factor
  FROM (SELECT *, exp(-0.5e0 * power(greatest(0e0, age / 3600e0) / 1e6, 2)) AS rec FROM raw) x),
good AS (SELECT * FROM fac WHERE raw * factor >= 0.55e0 * CASE path WHEN 'v' THEN 0.5e0 ELSE 0.7e0 END),
merged AS (SELECT coalesce(v.id, k.id) AS id, coalesce(v.raw, k.raw) AS raw, coalesce(v.factor, k.factor) AS factor, coalesce(k.bm25, 0) AS bm25
  FROM (SELECT * FROM good WHERE path = 'v') v FULL JOIN (SELECT * FROM good WHERE path = 'k') k ON k.id = v.id),
fused AS (SELECT id, factor, (1 - beta) * raw + beta * CASE WHEN hi - lo > 1e-6 THEN (bm25 - lo) / (hi - lo) WHEN hi > 1e-6 THEN 1 ELSE 0 END AS f
  FROM merged, (SELECT min(bm25) AS lo, max(bm25) AS hi
  FROM merged) m, (SELECT least(0.8e0, 0.2e0 + 0.15e0 * greatest(0e0, avg(idf) - 2.5e0)) AS beta FROM terms) b),
own AS (SELECT f.id, v.kind, v.title, v.content, v.prefix, v.session_id, v.confidence, f * factor / (1 + exp(-20 * (f - 0.6e0))) AS score
  FROM fused f JOIN vis v ON v.id = f.id WHERE v.session_id IS NULL OR v.prefix = 'u3'),
prim AS (SELECT id, prefix, score FROM own ORDER BY round(score, 9) DESC, id LIMIT 8), steps AS (SELECT id AS dst, lag(id) OVER (PARTITION BY conv_id
  ORDER BY turn) AS src FROM ep),
hop AS (SELECT s.src AS id, max(p.score * 0.5e0) AS near FROM prim p JOIN steps s ON s.dst = p.id JOIN ep e ON e.id = s.src
  WHERE e.prefix IS NOT DISTINCT FROM p.prefix AND e.scope IN ('src1', 'general') GROUP BY s.src),
wide AS (SELECT o.id, kind, title, content, prefix, session_id, confidence, greatest(score, coalesce(near, score)) AS score FROM own o LEFT
  JOIN hop ON hop.id = o.id UNION ALL SELECT e.id, 'episode', e.title, e.content, e.prefix, e.session_id, e.confidence, near FROM hop
  JOIN ep e ON e.id = hop.id WHERE e.id NOT IN (SELECT id FROM own)),
top AS (SELECT id, content FROM wide ORDER BY round(score, 9) DESC, id LIMIT 20),
  sent AS (SELECT id, i, unnest(list_filter(regexp_split_to_array(s, '[^\p{{L}}\p{{N}}-]+'), lambda x: x <> '' AND x NOT IN ({STOPS}))) AS term
  FROM (SELECT id, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM (SELECT id, regexp_split_to_array(lower(content), '[.\n]') AS parts
  FROM top) y) z),
cnt AS (SELECT id, i, term, count(*) AS n FROM sent GROUP BY id, i, term), cos AS (SELECT id, max(c) AS cosine FROM (SELECT id, i,
  coalesce(sum(n * idf * idf), 0) / (sqrt(sum(CAST(n AS DOUBLE) * n * coalesce(idf, 1) * coalesce(idf, 1))) * (SELECT sqrt(sum(idf * idf))
  FROM terms)) AS c FROM cnt LEFT JOIN terms ON terms.term = cnt.term GROUP BY id, i) w GROUP BY id),
boosted AS (SELECT w.*, w.score + 0.1e0 * coalesce(cosine, 0) + CASE WHEN prefix = 'u3' THEN 0.3556e0 ELSE 0 END AS s FROM wide w LEFT
  JOIN cos ON cos.id = w.id),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS k FROM boosted), heads AS (SELECT session_id, min(k) AS first FROM ranked
  WHERE k <= 10 AND session_id IS NOT NULL GROUP BY session_id), lacks AS (SELECT h.session_id, first, 3 - (SELECT count(*) FROM ranked r
  WHERE r.k <= 75 AND r.session_id = h.session_id) AS miss FROM heads h),
pulled AS (SELECT id, row_number() OVER (ORDER BY first, k) AS p FROM (SELECT r.id, r.k, l.first, row_number() OVER (PARTITION BY r.session_id
  ORDER BY r.k) AS j, l.miss FROM ranked r JOIN lacks l ON l.session_id = r.session_id WHERE r.k > 75) x WHERE j <= miss QUALIFY p <= 22),
listed AS (SELECT *, s * CASE WHEN kind = 'episode' THEN coalesce(confidence, 1) ELSE 1 END AS final FROM ranked WHERE k <= 75 - (SELECT count(*)
  FROM pulled) OR id IN (SELECT id FROM pulled)), five AS (SELECT *, row_number() OVER (ORDER BY round(final, 9) DESC, id) AS place FROM listed
  QUALIFY place <= 75),
kept AS (SELECT * FROM five f WHERE NOT EXISTS (SELECT 1 FROM five g JOIN ep e ON e.id = g.id
  WHERE g.place < f.place AND f.id = 'wiki_node:' || ((e.conv_id * 8 + e.turn) % 300)))
SELECT id, CASE kind WHEN 'episode' THEN 'session' WHEN 'wiki' THEN 'project' ELSE 'wisdom' END AS tier, title, round(final, 5) AS score,
  CAST(row_number() OVER (ORDER BY place) AS INT) AS place, CAST((SELECT count(*) FROM kept) AS INT) AS total, (SELECT count(*)
  FROM kept) > 15 AS has_more, 15 AS next_offset FROM kept QUALIFY row_number() OVER (ORDER BY place) <= 15"""


@query("SP K3 K4 K5 E1 J1 J2 J3 P1 P2 P14 W1 W2 W11 S10 S13 S14 S21 S28 S30 R3", SEARCH_SQL)
def search_results(t: Tables):
    """The first page of a search with a cue, a session and a scope, through all stages but the budget."""
    return search(memory(t), asked(t)).select("id", "tier", "title", F.round("score", 5).alias("score"), "place", "total", "has_more", "next_offset")


@query("SP W8 T17", None)
def search_packed(t: Tables):
    """The same within a budget of tokens: by hierarchy, cut to what is left, and on behind what doesn't fit."""
    return search(memory(t), asked(t, token_budget=6000)).select("id", "tier", "title", "content", "score", "place", "total", "omitted")


@query("SP", None)
def search_keywords(t: Tables):
    """Keywords alone, over all scopes, for nobody in particular, from the second page on."""
    return search(memory(t), asked(t, vector=None, session=None, everywhere=True, limit=5, offset=5, query="thnd ering", threshold=0.1)).select("id", "tier", "score", "place", "has_more", "next_offset")

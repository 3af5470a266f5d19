"""All queries of the package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import columns as c
from recollect.operators import folds, lines
from recollect.plans import basics, evaluation, feeds, graph, retrieval, saving, search, tables, texts
from recollect.plans.registry import REGISTRY, Tables, query

MODULES = (basics, evaluation, feeds, graph, retrieval, saving, search, tables, texts)


@query("T4", None)
def stem_terms(t: Tables):
    """The stemmer runs once a distinct term."""
    terms = t("documents").select(F.explode(lines.terms(F.col("text"))).alias("term")).distinct()
    return terms.select("term", lines.stemmed("term").alias("stem"))


def pooled(t: Tables, group: str, most: int):
    """The best rows of each group: a result list of a bounded length."""
    d = t("documents").withColumn("score", (F.col("doc_id") * 37 % 1009).cast("double"))
    return d.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "doc_id"))).where(F.col("k") <= most)


@query("W8 T17", None)
def token_packing(t: Tables):
    """Each source's result list within a budget, by hierarchy; what is too long is cut to what is left."""
    tier = F.element_at(F.array(F.lit("wisdom"), F.lit("project"), F.lit("session"), F.lit("working")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = pooled(t, "source", 75).withColumn("text", F.coalesce("text", F.lit("")))
    ranked = rows.select("source", F.col("doc_id").alias("id"), c.hierarchy(tier, F.lit(None).cast("string"), F.lit("")).alias("hierarchy"), "score", c.token_estimate(F.col("text")).alias("tokens"), "text")
    return folds.pack_budget(ranked, "source", 8000)


@query("W11", """WITH r AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id * 37 % 1009 DESC, doc_id) AS k FROM documents
  QUALIFY k <= 150), h AS (SELECT lang, source, min(k) AS first FROM r WHERE k <= 10 GROUP BY lang, source), m AS (SELECT h.*, 3 - (SELECT count(*)
  FROM r WHERE r.lang = h.lang AND r.source = h.source AND r.k <= 75) AS miss FROM h),
b AS (SELECT r.lang, r.doc_id, r.k, first, miss, row_number() OVER (PARTITION BY r.lang, r.source ORDER BY r.k) AS j FROM r
  JOIN m ON m.lang = r.lang AND m.source = r.source WHERE r.k > 75), p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang
  ORDER BY first, k) AS o FROM b WHERE j <= miss QUALIFY o <= 22), n AS (SELECT lang, count(*) AS n FROM p GROUP BY lang),
a AS (SELECT r.lang, r.doc_id, r.k AS o FROM r LEFT JOIN n ON n.lang = r.lang WHERE r.k <= 75 - coalesce(n, 0) UNION ALL
  SELECT lang, doc_id, 1000 + o FROM p) SELECT lang, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY o) AS rank FROM a""")
def diversity_promotion(t: Tables):
    """Sessions of the first ten get three rows each in the pool, from behind it."""
    return folds.promote_sessions(pooled(t, "lang", 150).select("lang", F.col("doc_id").alias("id"), F.col("source").alias("session_id"), "score"), "lang")


QUERIES = {name: q.spark for name, q in REGISTRY.items()}
ORACLE_SQL = {name: q.sql for name, q in REGISTRY.items() if q.sql}

"""Saves of several tables, batch after batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators import saves
from recollect.plans.registry import Tables, query
from recollect.sources import staging


def arrivals(t: Tables) -> DataFrame:
    """Turns as episodes: one path each, two tasks a user."""
    k, n = F.col("conv_id"), F.col("turn")
    name = F.concat(F.lit("e"), k, F.lit("_"), n)
    return t("conversations").select(
        name.alias("id"), F.concat(F.lit("p/"), name).alias("path"), F.concat(F.lit("Turn "), n).alias("title"), F.concat(name, F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"), F.lit("general").alias("scope"),
        F.concat(F.lit("u"), k % 5, F.lit("_"), k % 100).alias("session_id"), F.concat(F.lit("t"), k % 3).alias("task_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(k * 8 + n).cast("int"))).alias("created_at"), F.array("role").alias("entities"), n.alias("turn"),
    )


SAVED = """WITH c AS (SELECT 'e' || conv_id || '_' || turn AS id, conv_id, turn, role, conv_id * 8 + turn AS moment, 'u' || (conv_id % 5) || 't' || (conv_id % 3) AS k FROM conversations),
f1 AS (SELECT id, lag(id) OVER (PARTITION BY k ORDER BY moment, id) AS src FROM c WHERE turn % 2 = 0),
l AS (SELECT k, arg_max(id, moment) AS last FROM c WHERE turn % 2 = 0 GROUP BY k),
f2 AS (SELECT c.id, coalesce(lag(c.id) OVER (PARTITION BY c.k ORDER BY moment, c.id), l.last) AS src FROM c LEFT JOIN l ON l.k = c.k WHERE turn % 2 = 1)
SELECT 'episode' AS part, id AS a, CASE WHEN turn = 0 THEN 'Again' ELSE 'Turn ' || turn END AS b FROM c UNION ALL SELECT 'metrics', id, '50.0' FROM c UNION ALL
SELECT 'mention', id, CASE WHEN turn = 0 THEN 'changed' ELSE role END FROM c UNION ALL SELECT 'history', id, 'Turn 0' FROM c WHERE turn = 0 UNION ALL
SELECT 'followed', src, id FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) x WHERE src IS NOT NULL"""


@query("D1 D2 D3 D6 D14 D18", SAVED)
def saved_tables(t: Tables):
    """Two batches of new episodes and one that changes some: episodes, metrics, mentions, edges and old versions as they stand."""
    rows, store = arrivals(t), saves.Store(t.spark, staging.new_path(t.spark, "store"))
    store.save(rows.where("turn % 2 = 0").drop("turn"))
    store.save(rows.where("turn % 2 = 1").drop("turn"))
    again = rows.where("turn = 0").drop("turn").withColumn("title", F.lit("Again")).withColumn("content", F.concat("content", F.lit("!"))).withColumn("entities", F.array(F.lit("changed")))
    store.save(again.withColumn("id", F.concat("id", F.lit("x"))))
    part = lambda name, df, a, b: df.select(F.lit(name).alias("part"), F.col(a).alias("a"), F.col(b).cast("string").alias("b"))
    out = part("episode", store.episodes(), "id", "title")
    for name, df, a, b in (("metrics", store.rows("metrics"), "id", "utility"), ("mention", store.mentions(), "src", "entity"), ("history", store.rows("history"), "id", "title"), ("followed", store.rows("followed"), "src", "dst")):
        out = out.unionByName(part(name, df, a, b))
    return out

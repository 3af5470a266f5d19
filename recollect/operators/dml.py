"""Changes of stored tables as DataFrame rewrites: the result is the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `batch` replace those with their keys; among several of a key the last by updated_at wins."""
    new = latest(batch, keys, F.desc("updated_at"))
    return table.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_new(table: DataFrame, batch: DataFrame, text: str = "content") -> DataFrame:
    """`table` with the rows of `batch` whose content it doesn't have yet, each content once."""
    hashed = latest(batch.withColumn("content_hash", F.sha2(text, 256)), ["content_hash"], F.col("id"))
    return table.unionByName(hashed.join(table.select("content_hash"), "content_hash", "left_anti"), allowMissingColumns=True)


def history(table: DataFrame, batch: DataFrame, keys: list[str], changed_at: Column) -> DataFrame:
    """The old versions of the rows that `batch` replaces."""
    return table.join(batch.select(*keys).distinct(), keys, "left_semi").withColumn("changed_at", changed_at)


def checked_edges(edges: DataFrame, strict: bool = True) -> DataFrame:
    """Edges once a pair, confidence 1 where unset. An interval that ends before it starts is an error; if not `strict`, it is marked in
    `refused` (null where an end is open)."""
    wrong = F.col("valid_to") < F.col("valid_from")
    once = edges.dropDuplicates(["src", "dst"])
    if not strict:
        return once.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("refused", wrong)
    return once.withColumn("confidence", F.when(wrong, F.raise_error(F.lit("valid_to before valid_from"))).otherwise(F.coalesce("confidence", F.lit(1.0))))


def close_edges(edges: DataFrame, pairs: DataFrame, at: Column) -> DataFrame:
    """Edges of `pairs` end at a time; none is deleted."""
    hit = pairs.select("src", "dst").distinct().withColumn("_hit", F.lit(True))
    return edges.join(hit, ["src", "dst"], "left").withColumn("valid_to", F.when(F.col("_hit"), at).otherwise(F.col("valid_to"))).drop("_hit")


def sync_edges(have: DataFrame, want: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges to delete, edges to add)."""
    return have.join(want, keys, "left_anti"), want.join(have, keys, "left_anti")


def delete_node(tables: dict[str, tuple[DataFrame, list[str]]], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that name one of `ids` (id) in one of the given columns."""
    out = {}
    for name, (table, columns) in tables.items():
        for c in columns:
            table = table.join(ids.select(F.col("id").alias(c)), c, "left_anti")
        out[name] = table
    return out


def mirror(table: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still there."""
    return table.join(live.select(key).distinct(), key, "left_semi")


def hand_over(kv: DataFrame, parent: str, child: str) -> DataFrame:
    """The parent's values also as the child's."""
    return kv.unionByName(kv.where(F.col("session_id") == parent).withColumn("session_id", F.lit(child)))


def hand_over_all(kv: DataFrame, children: DataFrame) -> DataFrame:
    """All values, and each parent's also as its child's. children: session_id (the parent), child."""
    return kv.unionByName(kv.join(children, "session_id").select(F.col("child").alias("session_id"), *(c for c in kv.columns if c != "session_id")))


def kv_rows(rows: DataFrame, ttl: int = 300) -> DataFrame:
    """Rows (session_id, key, value, updated_at, ...) with `expires_at` in seconds: keys `broadcast:k[:seconds]` expire, `ttl` seconds
    later where none are said, and are kept as `broadcast:k`."""
    form = r"^(broadcast:[^:]+)(?::(\d+))?$"
    shared = F.col("key").rlike(form)
    said = F.regexp_extract("key", form, 2)
    life = F.when(said == "", ttl).otherwise(said.try_cast("long"))
    out = rows.withColumn("expires_at", F.when(shared, F.unix_timestamp("updated_at") + life))
    return out.withColumn("key", F.when(shared, F.regexp_extract("key", form, 1)).otherwise(F.col("key")))


def upsert_actions(have: DataFrame, batch: DataFrame) -> DataFrame:
    """What each row of `batch` (doc_id, path, hash; one a path) does to `have` (id, path, hash): update its path's row, keep the row of
    the same content, or be inserted (the first of a content). utility: what an inserted row's metrics start with."""
    by_path = have.select("path", F.col("id").alias("by_path"))
    by_hash = have.groupBy("hash").agg(F.min("id").alias("by_hash"))
    met = batch.join(by_path, "path", "left").join(by_hash, "hash", "left")
    new = F.col("by_path").isNull() & F.col("by_hash").isNull()
    first = met.where(new).groupBy("hash").agg(F.min("doc_id").alias("first"))
    rows = met.join(first, "hash", "left").withColumn("fresh", new & (F.col("first") == F.col("doc_id")))
    action = F.when(F.col("by_path").isNotNull(), "update").when(F.col("fresh"), "insert").otherwise("keep")
    return rows.select("doc_id", action.alias("action"), F.coalesce("by_path", "by_hash", "first").alias("id"), F.when(F.col("fresh"), 50).alias("utility"))


def updated(table: DataFrame, changes: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Rows that a condition holds for get its values; later changes win. Conditions are about the rows as they were."""
    values: dict[str, Column] = {}
    for test, new in changes:
        for name, value in new.items():
            values[name] = F.when(test, value).otherwise(values.get(name, F.col(name)))
    return table.select(*(values[c].alias(c) if c in values else F.col(c) for c in table.columns))

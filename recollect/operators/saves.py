"""Saves of several tables as one, taken back on failure.

A batch's rows are written beside what is there: episodes (each with the batch's number as its version), metrics of new ones, mentions, edges to what came before, old
versions of changed ones. Last comes the pointer, which names all parts of all tables; until then readers see the batches before. If
anything fails, what was written is deleted and the error goes on. A reader takes an episode's last version, and the mentions of that version. A batch
costs its own rows and a join with the keys that are there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import columns as c
from recollect.operators import dml

SCHEMAS = {
    "episodes": "id string, path string, title string, content string, scope string, session_id string, task_id string, created_at timestamp, content_hash string, version int",
    "metrics": "id string, utility double, access_count long",
    "mentions": "src string, entity string, version int",
    "followed": "src string, dst string",
    "history": "id string, title string, content_hash string, version int, replaced_by int",
}


class Store:
    """The tables under a folder that driver and executors share, for one writer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.parts: list[tuple[str, str, int]] = []  # of the last pointer: table, path, batch
        self.batch = 0
        root = self.path(f"{self.folder}/pointer")
        if root[1].exists(root[0]):
            rows = spark.read.schema("name string, path string, of int, batch int").parquet(f"{self.folder}/pointer")
            last = rows.agg(F.max("batch").alias("b")).first()["b"]
            if last is not None:
                self.batch = last
                self.parts = [(r["name"], r["path"], r["of"]) for r in rows.where(F.col("batch") == last).collect()]  # a row a table and batch

    def path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rows(self, name: str) -> DataFrame:
        paths = [p for n, p, _ in self.parts if n == name]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def episodes(self) -> DataFrame:
        return dml.latest(self.rows("episodes"), ["id"], F.desc("version"))

    def mentions(self) -> DataFrame:
        now = self.episodes().select(F.col("id").alias("src"), "version")
        return self.rows("mentions").join(now, ["src", "version"]).select("src", "entity")

    def entities(self) -> DataFrame:
        """Each name once, with the number of episodes that mention it."""
        return self.mentions().groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("mentions"))

    def save(self, batch: DataFrame) -> DataFrame:
        """batch: id, path (or null), title, content, scope, session_id, task_id, created_at, entities (array). A row whose path is there changes that episode; else one
        whose content is there, or comes before it in the batch, is passed over; others are new. A null id or content fails the whole batch. Returns what each row did: id, action, and the
        episode's id."""
        number, written = self.batch + 1, []

        def write(name: str, rows: DataFrame) -> DataFrame:
            path = f"{self.folder}/{name}/batch={number}-{uuid.uuid4().hex}"
            written.append((name, path))
            rows.write.parquet(path)
            return self.spark.read.schema(rows.schema).parquet(path)

        try:
            given = batch.withColumn("content", F.when(F.col("id").isNull() | F.col("content").isNull(), F.raise_error(F.lit("an episode has no id or no content"))).otherwise(F.col("content")))
            given = given.withColumn("content_hash", F.sha2("content", 256)).withColumn("scope", F.coalesce("scope", F.lit("general")))
            given = write("taken", given)
            have = self.episodes().select("id", "path", "content_hash")
            by_path = have.where("path IS NOT NULL").select("path", F.col("id").alias("by_path"))
            by_hash = have.groupBy("content_hash").agg(F.min("id").alias("by_hash"))
            one = dml.latest(given.where("path IS NOT NULL"), ["path"], F.desc("created_at"), F.col("id")).unionByName(given.where("path IS NULL"))  # the last of a path
            met = one.join(by_path, "path", "left").join(by_hash, "content_hash", "left")
            fresh = F.col("by_path").isNull() & F.col("by_hash").isNull()
            first = met.where(fresh).groupBy("content_hash").agg(F.min("id").alias("first"))
            met = met.join(first, "content_hash", "left").withColumn("fresh", fresh & (F.col("first") == F.col("id")))
            action = F.when(F.col("by_path").isNotNull(), "update").when(F.col("fresh"), "insert").otherwise("keep")
            done = write("actions", met.select("*", action.alias("action"), F.coalesce("by_path", "by_hash", "first").alias("episode")))
            changed = done.where("action <> 'keep'").withColumn("version", F.lit(number))
            inserted = changed.where("action = 'insert'")
            write("episodes", changed.select(F.col("episode").alias("id"), "path", "title", "content", "scope", "session_id", "task_id", "created_at", "content_hash", "version"))
            write("metrics", inserted.select("id", F.lit(50.0).alias("utility"), F.lit(0).cast("long").alias("access_count")))
            write("mentions", changed.select(F.col("episode").alias("src"), F.explode(F.array_distinct("entities")).alias("entity"), "version").where("entity IS NOT NULL"))
            old = self.episodes().join(changed.where("action = 'update'").select(F.col("episode").alias("id")), "id")
            write("history", old.select("id", "title", "content_hash", "version", F.lit(number).alias("replaced_by")))
            write("followed", self.linked(inserted))
            kept = [(n, p, number) for n, p in written if n in SCHEMAS]
            pointer = self.spark.createDataFrame([*self.parts, *kept], "name string, path string, of int")
            pointer.coalesce(1).write.parquet(f"{self.folder}/pointer/batch={number}")  # last: from here on the batch counts
        except Exception:
            for _, p in [*written, ("", f"{self.folder}/pointer/batch={number}")]:
                where, system = self.path(p)
                system.delete(where, True)
            raise
        self.parts, self.batch = [*self.parts, *kept], number
        return done.select("id", "action", "episode")

    def linked(self, inserted: DataFrame) -> DataFrame:
        """Edges from the episode before, of the same user and task: the last that is there, then those of the batch in turn."""
        keyed = lambda rows: rows.where("task_id IS NOT NULL AND session_id IS NOT NULL").select("id", c.user_prefix(F.col("session_id")).alias("user"), "task_id", "created_at")
        new = keyed(inserted).withColumn("new", F.lit(True))
        asked = new.select("user", "task_id").distinct()
        last = keyed(self.episodes()).join(asked, ["user", "task_id"], "left_semi").groupBy("user", "task_id").agg(F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("l"))
        both = new.unionByName(last.select("l.id", "user", "task_id", "l.created_at", F.lit(False).alias("new")))
        before = F.lag("id").over(Window.partitionBy("user", "task_id").orderBy("new", "created_at", "id"))
        return both.withColumn("src", before).where("new AND src IS NOT NULL").select("src", F.col("id").alias("dst"))

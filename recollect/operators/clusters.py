"""Greedy clusters that are kept over runs: a run's rows join the clusters that are there, the others make new ones. Earlier rows are never moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import graphs, vectors
from recollect.sources import staging

MEMBERS = "id long, cluster long, scope string, embedding array<double>, run int"


class Clusters:
    """A membership table under a folder, a part a run. A cluster is named by its seed, which may be its only row so far."""

    def __init__(self, spark: SparkSession, folder: str, least: float):
        self.spark, self.folder, self.least = spark, folder.rstrip("/"), least

    def members(self) -> DataFrame:
        return self.spark.read.schema(MEMBERS).parquet(f"{self.folder}/members")

    def clusters(self, least_rows: int = 2) -> DataFrame:
        """id, cluster, run of clusters with enough rows."""
        rows = self.members()
        sizes = rows.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
        return rows.join(sizes, "cluster").select("id", "cluster", "run")

    def add(self, run: int, rows: DataFrame) -> None:
        """rows: id, embedding of length 1, scope. Each joins the first seed (by run, then id) of its scope that is as close as the bar; the rest is clustered in order
        of id. A repeated run replaces itself."""
        new = staging.staged(vectors.typed(rows), "new-rows")
        free, taken = new, None
        if run:
            seeds = self.members().where((F.col("id") == F.col("cluster")) & (F.col("run") < run))
            near = vectors.within(seeds.select("id", "embedding", "scope"), new, self.least)
            first = near.join(seeds.select("id", "run"), "id").groupBy(F.col("query_id").alias("id")).agg(F.min_by("id", F.struct("run", "id")).alias("cluster"))
            taken = staging.staged(first, "joined")
            free = new.join(taken, "id", "left_anti")
        pairs = vectors.within(free, free, self.least).select(F.col("query_id").alias("a"), F.col("id").alias("b"))
        made = graphs.greedy_clusters(pairs, free.select("id"), least=1)
        every = made if taken is None else made.unionByName(taken)
        new.join(every, "id").select("id", "cluster", "scope", "embedding").write.mode("overwrite").parquet(f"{self.folder}/members/run={run}")

    def forget(self, run: int) -> None:
        """Without the rows of a run; what joined their clusters stays under their name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/members/run={run}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_left: set[str] = set()


def _sweep() -> None:
    """Deletes what was staged, when the driver's Python ends: results that were read until then needed it."""
    from pyspark import SparkContext

    if _left and SparkContext._jvm is not None:
        for path in _left:
            p = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(SparkContext._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


atexit.register(_sweep)


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where that is unset, a temporary folder of a local session, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="recollect-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/recollect-{label}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written and read back: the lineage is cut, and a lost executor costs no more than the plan behind it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Writers: redacted texts, result lines and reports. Spark's commit protocol stands in for temporary files and renames."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import columns


def write_texts(df: DataFrame, folder: str, column: str = "text") -> None:
    df.withColumn(column, columns.redacted(F.col(column))).write.parquet(folder)


def dealt(key: Column, name: Column) -> Column:
    """A file's path below one of 256 folders, so that neither a folder a file nor one large folder has to be listed."""
    return F.concat(F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(key), F.lit(256))), 2, "0")), F.lit("/"), name)


def write_files(df: DataFrame, folder: str) -> None:
    """A text file a row: `path` below the folder, `value` its content. The tasks write them, each under another name first, so a repeated task leaves
    whole files; nothing is moved or listed by the driver. By pyarrow's file systems, as the tail source reads."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = f"{inside}/{path}"
                above, name = posixpath.split(whole)
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                hidden = f"{above}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as f:
                    f.write((value or "").encode())
                system.move(hidden, whole)
        yield pa.record_batch([pa.array([], pa.int64())], names=["none"])

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    df.select("path", "value").repartition(tasks, "path").mapInArrow(write, "none long").write.format("noop").mode("overwrite").save()


def write_results(df: DataFrame, folder: str) -> None:
    df.write.json(folder)


def write_report(metrics: DataFrame, folder: str) -> None:
    """A markdown table; `metrics` is an aggregate of a few rows."""
    names = metrics.columns
    lines = metrics.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)), F.lit(" |")).alias("value"))
    head = metrics.sparkSession.createDataFrame([(f"| {' | '.join(names)} |",), (f"|{' --- |' * len(names)}",)], "value string")
    head.coalesce(1).union(lines.coalesce(1)).coalesce(1).write.text(folder)


def write_run(results: DataFrame, metrics: DataFrame, facts: dict[str, str], folder: str) -> None:
    """A run's result lines, its report, and last its manifest with what it was and how many results there are."""
    write_results(results, f"{folder}/results")
    write_report(metrics, f"{folder}/report")
    counted = results.agg(F.count("*").alias("results"))
    counted.select(*(F.lit(v).alias(k) for k, v in facts.items()), "results").coalesce(1).write.json(f"{folder}/manifest")

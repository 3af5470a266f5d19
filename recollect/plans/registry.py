"""Queries as DataFrame plans, each with the DuckDB SQL that it is checked against, written apart from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """tables("documents") reads a table of the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    """rows: the survey rows it covers; sql: None where SQL can't say it."""

    rows: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(rows: str, sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if build.__name__ in REGISTRY:
            raise ValueError(f"{build.__name__} is there already")
        REGISTRY[build.__name__] = Query(rows, build, sql)
        return build

    return add

"""A corpus pipeline of the operators in recollect.llm: stage by stage, each stored as Parquet and read again.

All stages but the last take and return the columns of `documents`, whatever others stand beside them and however they are called. An
empty table goes through as an empty table. Null and empty texts are toxic, near or repeated to nothing and hold no benchmark item, so
they stay; rows with a null doc_id stay unless their own text is toxic or holds an item; rows that share a doc_id are judged by the rule
of each operator, named below. Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import common, decontam, jaccard, packing, substring, toxicity
from recollect.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold, row by row; the grammar is learned from training labels alone, and without any
    the fixed one holds."""
    return toxicity.passing(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of texts linked by a Jaccard similarity of 0.8 or more on five-word shingles. Rows that share a
    doc_id are one node and stay or go together."""
    return jaccard.one_of_each(spark, docs, 5, 80, 100)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that also start in a document with a smaller doc_id; n_chars follows. Rows that share a doc_id
    don't shorten each other."""
    return substring.without_repeats(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; of rows that share a doc_id all go if one contains an item."""
    return decontam.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences; an empty text is a piece of the end id."""
    return packing.best_fit(spark, docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeated passages", drop_repeats), ("benchmark leaks", drop_leaks), ("packing", pack)]

#: SQL can express neither the learned grammar nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = common.staged(spark, stage(spark, docs, sf_dir), f"stage-{k}")
        common.drop_staged(spark, docs)
        docs = after
    return docs

"""An inverted index that is kept and changed by batches.

A folder of Parquet tables, a segment a batch: `postings` (term, id, scope, tf, dl), sorted by ranges of term and id, so a lookup reads the row groups of its terms
alone, however frequent another term is; `documents` (id, scope, dl, terms, and in what a batch wrote tfs); `removed` (id: gone from all earlier segments); `frequencies` (term, scope,
change of the document frequency); `sizes` (scope, changes of documents and their lengths). A batch is written beside what is there: its cost follows its own
size and that of the documents it removes. Readers add the segments up; `compacted` writes them as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import stem
from recollect.operators import lines, ranking

SCHEMAS = {
    "postings": "term string, id long, scope string, tf long, dl long, segment int",
    "documents": "id long, scope string, dl long, terms array<string>, segment int",
    "removed": "id long, segment int",
    "frequencies": "term string, scope string, df long, segment int",
    "sizes": "scope string, n_docs long, length long, segment int",
}
COUNTED = "id long, scope string, dl long, terms array<string>, tfs array<long>"


def lengths_of(words: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with `most` words together, or one longer row."""
    ends, start = np.concatenate(([0], np.cumsum(lengths))), 0
    while start < len(lengths):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, end
        start = end


def counts_of(words: pa.Array, stems: bool) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of rows of words: their numbers, their terms, each once, and how often each is there. A word that many rows have is stemmed once."""
    lengths = lengths_of(words)
    known = words.flatten().dictionary_encode()
    codes, names = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary
    if stems:
        made = pa.array([stem.stem(w) for w in names.to_pylist()], names.type).dictionary_encode()
        codes, names = made.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], made.dictionary
    width = max(len(names), 1)
    keys, tfs = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + codes, return_counts=True)
    bounds = pa.array(np.searchsorted(keys, np.arange(len(lengths) + 1) * width), pa.int32())
    return pa.array(lengths), pa.ListArray.from_arrays(bounds, names.take(pa.array(keys % width))), pa.ListArray.from_arrays(bounds, pa.array(tfs.astype(np.int64)))


class Index:
    """An index under a folder that driver and executors share. `stems`: terms are stemmed, at writing and at asking."""

    def __init__(self, spark: SparkSession, folder: str, stems: bool = True):
        self.spark, self.folder, self.stems = spark, folder.rstrip("/"), stems

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def write(self, name: str, rows: DataFrame, segment: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/segment={segment}")  # a repeated batch replaces itself

    def terms_of(self, rows: DataFrame, keys: list[str], text: str) -> DataFrame:
        """keys, term, tf, and a row with a null term and tf 0 for a row without terms. Texts are dealt by their first key once; only
        stemmed counts are dealt by it again, as Spark forgets the order behind Python."""
        words = rows.repartition(keys[0]).select(*keys, F.explode_outer(lines.terms(F.col(text))).alias("term"))
        counts = words.groupBy(*keys, "term").agg(F.count("term").alias("tf"))
        if not self.stems:
            return counts
        return counts.withColumn("term", lines.stemmed("term")).repartition(keys[0]).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))

    def counted(self, docs: DataFrame, most: int = 1 << 21) -> DataFrame:
        """id, scope, dl, terms, tfs of documents (id, scope, text; each once): a document is counted where it is, so no row a word is dealt or
        sorted. A task holds a batch of texts and the numbers of `most` words."""
        stems = self.stems

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, end in slices(lengths_of(batch.column("words")), most):
                    part = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("scope"), *counts_of(part.column("words"), stems)], ["id", "scope", "dl", "terms", "tfs"])

        return docs.repartition("id").select("id", "scope", lines.terms(F.col("text")).alias("words")).mapInArrow(run, COUNTED)

    def gathered(self, docs: DataFrame) -> DataFrame:
        """The same where rows share an id and scope: they are one document, counted by a row a word."""
        found = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
        whole = self.terms_of(docs, ["id", "scope"], "text").groupBy("id", "scope").agg(F.sum("tf").alias("dl"), found.alias("found"))
        return whole.select("id", "scope", "dl", F.col("found.term").alias("terms"), F.col("found.tf").alias("tfs"))

    def change(self, segment: int, added: DataFrame, removed: DataFrame | None = None) -> None:
        """Batch number `segment`, from 0: `removed` (id) leaves all earlier segments, `added` (id, scope, text; ids once) comes. A changed document is both. Ids
        that aren't there are passed over; a null text has no terms, but is a document."""
        gone = removed.select(F.col("id").cast("long").alias("id")).distinct() if removed is not None else self.spark.createDataFrame([], "id long")
        self.write("removed", gone, segment)
        docs = added.select(F.col("id").cast("long").alias("id"), F.coalesce("scope", F.lit("general")).alias("scope"), F.col("text").cast("string").alias("text"))
        once = docs.groupBy("id", "scope").count().where("count > 1").isEmpty()
        self.write("documents", self.counted(docs) if once else self.gathered(docs), segment)
        whole = self.spark.read.schema(COUNTED).parquet(f"{self.folder}/documents/segment={segment}")
        rows = whole.select("id", "scope", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("f")).select(F.col("f.terms").alias("term"), "id", "scope", F.col("f.tfs").alias("tf"), "dl")
        self.write("postings", rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), segment)
        lost = self.live("documents", segment - 1).join(gone, "id", "left_semi") if segment else None
        counts = self.table("postings").where(F.col("segment") == segment).select("term", "scope", F.lit(1).alias("sign"))  # in order of terms, so few are left to deal
        change = whole.select("scope", F.lit(1).alias("sign"), "dl")
        if lost is not None:
            counts = counts.unionByName(lost.select(F.explode("terms").alias("term"), "scope", F.lit(-1).alias("sign")))
            change = change.unionByName(lost.select("scope", F.lit(-1).alias("sign"), "dl"))
        self.write("frequencies", counts.groupBy("term", "scope").agg(F.sum("sign").alias("df")).where("df <> 0"), segment)
        self.write("sizes", change.groupBy("scope").agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("dl")).alias("length")), segment)

    def live(self, name: str, upto: int | None = None) -> DataFrame:
        """Rows of documents that are still there (after segment `upto`)."""
        rows, gone = self.table(name), self.table("removed").select(F.col("id").alias("gone"), F.col("segment").alias("at"))
        if upto is not None:
            rows, gone = rows.where(F.col("segment") <= upto), gone.where(F.col("at") <= upto)
        last = gone.groupBy("gone").agg(F.max("at").alias("at"))
        return rows.join(last, (F.col("id") == F.col("gone")) & (F.col("segment") < F.col("at")), "left_anti")

    def frequencies(self) -> DataFrame:
        """term, scope, df."""
        return self.table("frequencies").groupBy("term", "scope").agg(F.sum("df").alias("df")).where("df > 0")

    def compacted(self, folder: str) -> Index:
        """The live rows as one segment of a new index."""
        out = Index(self.spark, folder, self.stems)
        out.write("postings", self.live("postings").drop("segment").repartitionByRange("term", "id").sortWithinPartitions("term", "id"), 0)
        out.write("documents", self.live("documents").drop("segment"), 0)
        out.write("removed", self.spark.createDataFrame([], "id long"), 0)
        out.write("frequencies", self.frequencies(), 0)
        out.write("sizes", self.table("sizes").groupBy("scope").agg(F.sum("n_docs").alias("n_docs"), F.sum("length").alias("length")), 0)
        return out

    def asked(self, questions: DataFrame) -> DataFrame:
        """question, term, each once. questions: question, text."""
        return self.terms_of(questions.select("question", "text"), ["question"], "text").where("term IS NOT NULL").select("question", "term")

    def scored(self, questions: DataFrame, scopes: list[str] | None = None, few: int = 1 << 16) -> DataFrame:
        """question, id, bm25 of all documents with a term of the question. Frequencies and sizes are those of `scopes` (None: all). Of
        `few` distinct terms or fewer, only their row groups are read; more are joined."""
        wanted = self.asked(questions).persist()
        of = (lambda df: df.where(F.col("scope").isin(scopes))) if scopes else (lambda df: df)
        sizes = of(self.table("sizes")).agg(F.sum("n_docs").alias("n_docs"), (F.sum("length") / F.sum("n_docs")).alias("avgdl"))
        terms = wanted.select("term").distinct()
        n = terms.count()
        rows, counts = of(self.live("postings")), of(self.table("frequencies"))
        if n <= few:
            known = [r["term"] for r in terms.collect()]  # of the questions, not of the documents
            rows, counts = rows.where(F.col("term").isin(known)), counts.where(F.col("term").isin(known))
        counts = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        rows = rows.select("term", "id", "tf", "dl")
        if n <= few:
            rows, wanted, counts = rows.repartition("id"), F.broadcast(wanted), F.broadcast(counts)  # a posting is dealt once, not once a question
        return ranking.bm25(rows.join(wanted, "term"), sizes, [], counts).select("question", "id", "bm25")

    def top(self, questions: DataFrame, k: int, scopes: list[str] | None = None) -> DataFrame:
        """question, id, bm25, rank."""
        return ranking.first(self.scored(questions, scopes), ["question"], "bm25", k, "id")

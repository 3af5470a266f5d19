"""Removal of repeated word windows: a De Bruijn graph of word k-mers, compacted before and behind Spark joins.

Edges of the graph are windows of k words. A text has about as many of them as words, so they are compacted before they are
joined. Each window has an anchor: the least hash among its runs of m words. Equal windows have equal anchors, and neighbours
mostly share theirs; a maximal run of windows with one anchor is a nonbranching path of up to k - m + 1 edges, named by its words
(128 bits).

1. Anchors are grouped; those in one document alone cannot lie in a window of another. The rest go into a bit table of fixed
   size, which only spares work: what passes it wrongly is sorted out later.
2. Paths whose anchor passes are grouped by name: the least (doc_id, start) is a path's source. Occurrences join their path; in a
   document that isn't the source's, the whole path is repeated.
3. Where one anchor has several paths, they branch: single windows may be shared though the paths are not. Those windows
   alone are taken one by one, and grouped and joined in the same way.
4. Along a document, repeated pieces whose sources follow each other in one source document become a single span (start, words,
   source, source start).
5. Source coordinates verify the spans: the words of a span and of its source, cut out of both texts, have to be equal.
6. Spans are joined to their texts and the words that they cover are dropped.

Compacting the paths at their nodes instead, by degrees and pointer doubling (a join a round), gave the same results at 1663 CPU
seconds a GB and 3.83 times the input of disk, against budgets of 960 and 4; so step 4 is a window over each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm import common

WIDTH, ANCHOR = 13, 5
TABLE_BITS = 27
ODD_SPACE = np.array([9, 10, 11, 12, 13], np.uint8)
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def window_anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Least of each `span` consecutive hashes."""
    out, reach = grams, 1
    while reach < span:
        step = min(reach, span - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


def names_at(h: np.ndarray, grams: np.ndarray, at: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the windows at some places: a hash of their words, and one of their runs of m words, which cover them."""
    other = np.zeros(len(at), np.uint64)
    for i in [*range(0, k - m, m), k - m]:
        other = common.finish((other + grams[at + i]) * common.MIX[i % len(common.MIX)])
    return common.grams_at(h, at, k), other


def _windows(found: common.Words, k: int, m: int):
    """(text, place of its first window among all words, anchors of its windows) of each text with a window, and all runs of m words."""
    if len(found.hashes) < k:
        return [], np.empty(0, np.uint64)
    grams = common.gram_hashes(found.hashes, m)
    anchors = window_anchors(grams, k - m + 1)
    bounds = zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)
    return [(i, a, anchors[a : b - k + 1]) for i, (a, b) in enumerate(bounds) if b - a >= k], grams


def shared_anchors(docs: DataFrame, k: int, m: int) -> DataFrame:
    """Anchors that at least two documents have."""

    def run(batches):
        for whole in batches:
            for batch in common.chunks(whole):
                found = common.Words(batch.column(1))
                ids, parts = batch.column(0).to_numpy(zero_copy_only=False), []
                for i, _, anchors in _windows(found, k, m)[0]:
                    parts.append((i, common.distinct(anchors)))
                if parts:
                    docs_of = np.repeat(ids[[i for i, _ in parts]], [len(a) for _, a in parts])
                    yield pa.record_batch([pa.array(np.concatenate([a for _, a in parts]).view(np.int64)), pa.array(docs_of, pa.int64())], names=["anchor", "doc_id"])

    ends = common.ids_and_text(docs).where("doc_id IS NOT NULL").mapInArrow(run, "anchor long, doc_id long").groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return ends.where("first < last").select("anchor")


def paths(anchors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of windows) of the runs of equal anchors in a text; a longer run is cut after `most` windows."""
    run = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    inside = np.arange(len(anchors)) - np.repeat(run, np.diff(np.append(run, len(anchors))))
    start = np.flatnonzero(inside % most == 0)
    return start, np.diff(np.append(start, len(anchors)))


def path_names(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    return common.finish(common.finish(first * common.MIX[1] + n.astype(np.uint64)) + last * common.MIX[2])


PIECES = "name long, name2 long, anchor long, doc_id long, start int, n int"


def marked_pieces(docs: DataFrame, table, k: int, m: int, bits: int, single: bool) -> DataFrame:
    """Paths, or with `single` windows, whose anchor's bit is set: name (two halves), anchor, doc_id, start, n (windows)."""

    def run(batches):
        marked = table.value
        for whole in batches:
            for batch in common.chunks(whole):
                found = common.Words(batch.column(1))
                ids, cols = batch.column(0).to_numpy(zero_copy_only=False), []
                texts, grams = _windows(found, k, m)
                for i, at, anchors in texts:
                    start, n = (np.arange(len(anchors)), np.ones(len(anchors), np.int64)) if single else paths(anchors, k - m + 1)
                    keep = np.flatnonzero(common.bits_set(marked, anchors[start], bits))
                    if len(keep):
                        start, n = start[keep], n[keep]
                        cols.append((anchors[start].view(np.int64), np.full(len(start), ids[i], np.int64), start.astype(np.int32), n.astype(np.int32), at + start))
                if cols:
                    *made, places = [np.concatenate(c) for c in zip(*cols, strict=True)]
                    names = names_at(found.hashes, grams, places, k, m)
                    if not single:
                        names = [path_names(a, b, made[3]) for a, b in zip(names, names_at(found.hashes, grams, places + made[3] - 1, k, m), strict=True)]
                    yield pa.record_batch([*(pa.array(x.view(np.int64)) for x in names), *map(pa.array, made)], names=[c.split()[0] for c in PIECES.split(", ")])

    return common.ids_and_text(docs).where("doc_id IS NOT NULL").mapInArrow(run, PIECES)


def sources(pieces: DataFrame, *more: str) -> DataFrame:
    """Per name the least (doc_id, start), as one number, so that it is aggregated by hash, and the greatest doc_id."""
    place = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 32) + F.col("start")
    return pieces.groupBy("name", "name2").agg(F.min(place.cast("decimal(38,0)")).alias("place"), F.max("doc_id").alias("last"), *(F.min(c).alias(c) for c in more))


def repeats(pieces: DataFrame, firsts: DataFrame) -> DataFrame:
    """Occurrences outside the source's document: doc_id, start, n, source, at. `firsts`, names that several documents have, is a
    stored table, so that a name with very many occurrences can be split over tasks."""
    named = firsts.select("name", "name2", F.col("source"), F.expr("CAST(place - CAST(source AS DECIMAL(20,0)) * CAST(4294967296 AS DECIMAL(10,0)) AS INT)").alias("at"))
    return pieces.select("name", "name2", "doc_id", "start", "n").join(named, ["name", "name2"]).where("doc_id > source").select("doc_id", "start", "n", "source", "at")


def several(firsts: DataFrame) -> DataFrame:
    """Names that more than one document has, with their source's document."""
    return firsts.withColumn("source", F.expr("CAST(floor(place / CAST(4294967296 AS DECIMAL(10,0))) AS BIGINT)")).where("source < last")


def repeated_spans(spark: SparkSession, docs: DataFrame, k: int = WIDTH, m: int = ANCHOR, bits: int = TABLE_BITS) -> DataFrame:
    """Spans (doc_id, start, n_words, source, source_start) of windows that also start in a document with a smaller doc_id."""
    anchors = common.staged(spark, shared_anchors(docs, k, m), "anchors")
    table = spark.sparkContext.broadcast(common.bit_table(anchors, bits))
    common.drop_staged(spark, anchors)
    runs = common.staged(spark, marked_pieces(docs, table, k, m, bits, single=False), "paths")
    firsts = common.staged(spark, sources(runs, "anchor"), "path-sources")
    branching = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    forks = spark.sparkContext.broadcast(common.bit_table(branching, bits))
    whole = common.staged(spark, repeats(runs, several(firsts)), "repeated-paths")
    common.drop_staged(spark, runs, firsts)
    windows = common.staged(spark, marked_pieces(docs, forks, k, m, bits, single=True).drop("anchor"), "windows")
    firsts = common.staged(spark, several(sources(windows)), "window-sources")
    single = common.staged(spark, repeats(windows, firsts), "repeated-windows")
    common.drop_staged(spark, windows, firsts)
    along = Window.partitionBy("doc_id").orderBy("start", "n")
    reach = F.lag(F.col("start") + F.col("n")).over(along)
    ahead = F.lag(F.col("at") + F.col("n")).over(along)
    fresh = (F.col("start") != reach) | (F.col("source") != F.lag("source").over(along)) | (F.col("at") != ahead)  # overlaps only cut spans
    cut = whole.union(single).withColumn("span", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cut.groupBy("doc_id", "span", "source").agg(F.min("start").alias("start"), (F.sum("n") + k - 1).cast("int").alias("n_words"), F.min("at").alias("source_start"))
    out = common.staged(spark, spans.select("doc_id", "start", "n_words", "source", "source_start"), "spans")
    common.drop_staged(spark, whole, single)
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with a last column of their spans, at most a document's words; its name is none of theirs."""
    name = common.reserved(docs.columns)
    per_doc = spans.groupBy(F.col("doc_id").alias(f"{name}doc")).agg(F.collect_list(F.struct("start", "n_words")).alias(f"{name}spans"))
    return docs.join(per_doc, F.col("doc_id") == F.col(f"{name}doc"), "left").drop(f"{name}doc")


def kept_texts(found: common.Words, spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, words gone) of a batch's texts without the words in their spans, the others joined by one space."""
    counts = found.count()
    cover = np.zeros(len(found.start) + 1, np.int32)
    for i, of in enumerate(spans):
        for s in of or ():
            cover[found.first[i] + s["start"]] += 1
            cover[found.first[i] + s["start"] + s["n_words"]] -= 1
    keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    text = np.repeat(np.arange(len(counts)), counts)[keep]
    edge = np.zeros(len(found.data) + 1, np.int8)
    edge[found.start[keep]] += 1
    edge[found.end[keep]] -= 1  # a word never begins where another ends
    stay = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    gaps = found.start[keep[1:][text[1:] == text[:-1]]] - 1  # one separator before each kept word but a text's first
    data = found.data.copy()
    data[gaps] = 32
    stay[gaps] = True
    bounds = np.concatenate(([0], np.cumsum(stay)))[found.offsets]
    return data[stay], bounds, counts - np.bincount(text, minlength=len(counts))


def digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document its words, those that `spans` cover, and the digest of the others, joined by one space."""

    def run(batches):
        for whole in batches:
            for batch in common.chunks(whole):
                found = common.Words(batch.column(1))
                data, bounds, gone = kept_texts(found, batch.column(2).to_pylist())
                out = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.record_batch([batch.column(0), pa.array(found.count(), pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(common.ids_and_text(docs), spans).mapInArrow(run, OUT)


def rewritten(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with all columns; a text with spans becomes its other words, joined by one space (n_chars follows, where there
    is one), others stay as they are."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for whole in batches:
            for batch in common.chunks(whole, text=at):
                found, texts = common.Words(batch.column(at)), batch.column(at).to_pylist()
                spans = batch.column(len(names)).to_pylist()
                hit = [i for i, of in enumerate(spans) if of]
                if hit:
                    data, bounds, _ = kept_texts(found, spans)
                    for i in hit:
                        texts[i] = data[bounds[i] : bounds[i + 1]].tobytes().decode()
                cols = list(batch.columns[: len(names)])
                cols[at] = pa.array(texts, pa.string())
                if hit and "n_chars" in names:
                    sizes = cols[names.index("n_chars")].to_pylist()
                    for i in hit:
                        sizes[i] = len(texts[i])
                    cols[names.index("n_chars")] = pa.array(sizes, cols[names.index("n_chars")].type)
                yield pa.record_batch(cols, names=names)

    return with_spans(docs, spans).mapInArrow(run, docs.schema)


def span_digests(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A 128-bit digest of the words of each wanted span (doc_id, start, n_words)."""
    per_doc = wanted.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))

    def run(batches):
        for whole in batches:
            for batch in common.chunks(whole):
                found, rows = common.Words(batch.column(1)), []
                raw, plain = found.data, not np.isin(found.data, ODD_SPACE).any()
                for i, (doc, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    a = int(found.first[i])
                    gap_ok = found.start[a + 1 : int(found.first[i + 1])] - found.end[a : int(found.first[i + 1]) - 1]
                    single = np.concatenate(([0], np.cumsum(gap_ok != 1))) if len(gap_ok) else np.zeros(1, np.int64)
                    for s in spans:
                        x, y = a + s["start"], a + s["start"] + s["n_words"]
                        if y > int(found.first[i + 1]):
                            continue
                        low, high = int(found.start[x]), int(found.end[y - 1])
                        text = raw[low:high].tobytes()
                        if single[y - 1 - a] != single[x - a] or not plain:
                            text = b" ".join(text.split())
                        rows.append((doc, s["start"], s["n_words"], xxhash.xxh3_128_digest(text)))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "start", "n_words", "digest"])

    return common.ids_and_text(docs).join(per_doc, "doc_id").mapInArrow(run, "doc_id long, start int, n_words int, digest binary")


def verify(spark: SparkSession, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Those of `spans` whose words are the words at their source. Rows that share a doc_id can't be told apart by coordinates:
    a span stays if any of them has the words."""
    here = spans.select("doc_id", "start", "n_words")
    there = spans.select(F.col("source").alias("doc_id"), F.col("source_start").alias("start"), "n_words")
    digests = common.staged(spark, span_digests(docs, here.union(there)).distinct(), "digests")
    source = digests.select(F.col("doc_id").alias("source"), F.col("start").alias("source_start"), "n_words", F.col("digest").alias("expected"))
    same = spans.join(digests, ["doc_id", "start", "n_words"]).join(source, ["source", "source_start", "n_words"]).where("digest = expected")
    out = common.staged(spark, same.select("doc_id", "start", "n_words").distinct(), "verified")
    common.drop_staged(spark, digests)
    return out


def dedup(spark: SparkSession, docs: DataFrame, k: int = WIDTH) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256. Words are as in common.Words, unchanged. Null and empty texts have no
    words; rows with null doc_id keep all their words and are no one's source; repeated rows, which share a doc_id, are no
    smaller than each other. Very long texts are taken whole; other columns of `docs` aren't read."""
    return digests(docs, verify(spark, docs, repeated_spans(spark, docs, k)))


def without_repeats(spark: SparkSession, docs: DataFrame, k: int = WIDTH) -> DataFrame:
    """`docs` with all columns, whatever their names, and shortened texts, under the rules of dedup()."""
    common.small_batches(spark)
    return rewritten(docs, verify(spark, docs, repeated_spans(spark, docs, k)))


def oracle(k: int = WIDTH) -> str:
    """DuckDB SQL of dedup() over documents, from all windows as text."""
    words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""WITH t AS (SELECT doc_id, {words} AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - {k - 2})) AS i, w FROM t WHERE len(w) >= {k}),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
covered AS (SELECT DISTINCT doc_id, i + unnest(range(0, {k})) AS i FROM windows JOIN firsts USING (s) WHERE f < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS s FROM each e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""

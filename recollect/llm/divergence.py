"""Divergence audit of sources: how far the word shares of each source lie from those of every other source of its language.

Counts of terms are taken a slice of texts at a time and summed by Spark. The terms of a language are dealt into blocks by a hash, its
sources into blocks by number. For each block of terms and pair of blocks of sources one task has a dense tile, sources by terms,
in 64-bit integers: counts become shares, all pairs of the tile are compared by broadcasting, and the tile's sums are one partial matrix of
pairs. Spark sums the partial matrices; the best terms of each source are kept a tile at a time and merged by rank. A tile's size is a
parameter, whatever the number of sources and terms.

All arithmetic is on integers. A share is 1 + floor(10**9 * (count + 2) / (total + 2 * terms)), taken in three steps of 1000, so counts
up to 9 * 10**15 are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm import common

LEAST_DOCS, TOP = 10, 10
TILE_TERMS, TILE_SOURCES = 2048, 128
HELD = 400_000
COUNTS = "lang string, source string, term string, n long, n_docs long"
TILES = "part string, lang string, source string, item string, value long"

#: Bytes of a term: A-Z, a-z and all bytes of characters outside ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def summed(by: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of runs; `by` are the runs' first places."""
    return tuple(np.add.reduceat(v, by) if len(v) else v for v in values)


def run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Tally:
    """Counts of (lang, source, term) of one task, emptied when it holds HELD entries. Terms are told apart by length and 64-bit hash
    within a task, as strings between tasks."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.rows: list[int] = []
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        of = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k = self.groups.setdefault(key, len(self.groups))
            if k == len(self.rows):
                self.rows.append(0)
            self.rows[k] += 1
            of.append(k)
        data, offsets = common.text_buffer(batch.column(2))
        data = common.LOWER[data]
        bound = np.zeros(len(data) + 1, bool)
        bound[offsets] = True
        letter = np.concatenate(([False], LETTER[data], [False]))
        start = np.flatnonzero(letter[1:-1] & (~letter[:-2] | bound[:-1]))
        end = np.flatnonzero(letter[1:-1] & (~letter[2:] | bound[1:])) + 1
        if not len(start):
            return
        doc = np.searchsorted(offsets, start, "right") - 1
        h = common.run_hashes(data, start, end)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = run_starts(doc, h)
        n = np.diff(np.append(first, len(h)))
        g, h, at = np.array(of, np.int64)[doc[first]], h[first], order[first]
        order = np.lexsort((h, g))
        g, h, n, at = g[order], h[order], n[order], at[order]
        first = run_starts(g, h)
        n_docs = np.diff(np.append(first, len(h)))
        at = at[first]
        size = end[at] - start[at]
        ends = np.cumsum(size)
        flat = data[np.repeat(start[at] - (ends - size), size) + np.arange(int(ends[-1]))]
        terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(flat)])
        self.parts.append((g[first], h[first], summed(first, n)[0], n_docs, terms))
        self.size += len(at)

    def flush(self) -> pa.RecordBatch | None:
        if not self.groups:
            return None
        keys = list(self.groups)
        langs, sources = pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())
        g = np.concatenate([p[0] for p in self.parts] or [np.empty(0, np.int64)])
        h = np.concatenate([p[1] for p in self.parts] or [np.empty(0, np.uint64)])
        order = np.lexsort((h, g))
        first = run_starts(g[order], h[order])
        n, n_docs = (summed(first, np.concatenate([p[k] for p in self.parts] or [np.empty(0, np.int64)])[order])[0] for k in (2, 3))
        terms = pa.concat_arrays([p[4] for p in self.parts] or [pa.array([], pa.large_binary())]).take(pa.array(order[first]))
        of = pa.array(np.concatenate((g[order][first], np.arange(len(keys)))))
        out = {
            "lang": langs.take(of),
            "source": sources.take(of),
            "term": pa.concat_arrays([terms.cast(pa.large_string()).cast(pa.string()), pa.nulls(len(keys), pa.string())]),
            "n": pa.array(np.concatenate((n, np.zeros(len(keys), np.int64)))),
            "n_docs": pa.array(np.concatenate((n_docs, self.rows))),
        }
        self.__init__()
        return pa.record_batch(out)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (documents, which are rows), and a row with a null term for each pair of lang and
    source. Null text, lang and source are empty."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        tally = Tally()
        for whole in batches:
            for batch in common.chunks(whole, text=2):
                tally.add(batch)
                if tally.size > HELD:
                    yield tally.flush()
        if (left := tally.flush()) is not None:
            yield left

    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return given.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), exactly."""
    over, rest = total + 2 * terms, n + 2
    out = np.zeros(np.broadcast_shapes(rest.shape, over.shape), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + whole
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) of shares; squares stay under 2**63."""
    return (p - q) ** 2 // (p + q)


def compare(tile: pa.Table, top: int) -> pa.Table:
    """One tile: partial sums of the pairs of its sources, and the best terms of each where it has one block of sources on both sides. Rows
    with a null term are the sources."""
    named = pc.is_null(tile["term"])
    groups, entries = tile.filter(named).sort_by("g"), tile.filter(pc.invert(named))
    g = groups["g"].to_numpy()
    sources, total = groups["source"].to_pylist(), groups["total"].to_numpy()
    first, second = tile["block_a"][0].as_py(), tile["block_b"][0].as_py()
    lang, n_terms = tile["lang"][0].as_py(), tile["terms"][0].as_py()
    words = entries["term"].combine_chunks().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    terms = words.dictionary.to_pylist()
    counts = np.zeros((len(g), len(terms)), np.int64)
    col = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts[np.searchsorted(g, entries["g"].to_numpy()), col] = entries["n"].to_numpy()
    p = shares(counts, total[:, None], n_terms) if terms else counts
    absent = groups["in_block"][0].as_py() - len(terms)  # terms of the block that none of these sources has
    none = shares(np.zeros(len(g), np.int64), total, n_terms) if absent else total
    out: list[tuple] = []
    a = np.flatnonzero(groups["own"].to_numpy() == first)
    b = np.flatnonzero(groups["own"].to_numpy() == second)
    for i in a.tolist():
        others = b[b > i]
        value = distance(p[i][None, :], p[others]).sum(axis=1)
        if absent:
            value += absent * distance(none[i], none[others])
        out += [("pair", lang, sources[i], sources[j], v) for j, v in zip(others.tolist(), value.tolist(), strict=True)]
    if first == second and terms:
        whole = np.zeros(len(terms), np.int64)
        whole[col] = entries["n_lang"].to_numpy()
        q = shares(whole, tile["total_lang"].to_numpy()[:1], n_terms)
        place = np.empty(len(terms), np.int64)
        place[sorted(range(len(terms)), key=lambda k: terms[k].encode())] = np.arange(len(terms))
        for i in a.tolist():
            here = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = distance(p[i][here], q[here])
            for k in np.lexsort((place[here], -value))[:top].tolist():
                out.append(("term", lang, sources[i], terms[here[k]], int(value[k])))
    cols = list(zip(*out, strict=True)) or [()] * 5
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["part", "lang", "source", "item", "value"])


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, tile_terms: int = TILE_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank. `pair`: each other source of the language, by distance over all terms
    that at least `least_docs` of the language's documents have; `term`: the `top` terms that the source uses more than its language.

    Null text, lang and source are empty strings, so a value of their own. Repeated rows are documents; equal values are ranked by item. A
    source without terms is compared like others; a language without kept terms has pairs at 0 and no terms; a language of one source
    has no pairs; an empty table gives no rows. Texts are read whole, however long; other columns aren't read."""
    counts = common.staged(spark, term_counts(docs), "term-counts")
    per_term = Window.partitionBy("lang", "term")
    entries = counts.where("term IS NOT NULL").withColumn("n_lang", F.sum("n").over(per_term)).withColumn("df", F.sum("n_docs").over(per_term))
    entries = entries.withColumn("first", (F.col("source") == F.min("source").over(per_term)).cast("long")).where(F.col("df") >= least_docs)
    entries = common.staged(spark, entries.select("lang", "source", "term", "n", "n_lang", "first"), "kept-terms")
    of_lang = entries.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.sum("first").alias("terms"))
    of_source = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = counts.where("term IS NULL").select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "total_lang", "terms"]).withColumn("g", F.row_number().over(order) - 1)
    groups = groups.withColumn("own", F.floor(F.col("g") / tile_sources)).withColumn("n_own", F.floor(F.max("g").over(Window.partitionBy("lang")) / tile_sources) + 1)
    groups = common.staged(spark, groups.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / tile_terms))), "sources")
    common.drop_staged(spark, counts)
    keyed = common.beside(entries, groups, ["lang", "source"], groups.count())
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")))
    sizes = keyed.groupBy("lang", "block").agg(F.sum("first").alias("in_block"))
    heads = groups.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_lang"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    heads = heads.join(sizes, ["lang", "block"], "left").na.fill(0, ["in_block"])
    both = keyed.drop("first").withColumn("in_block", F.lit(0).cast("long")).unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_own") - 1)))
    both = both.withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other"))
    both = both.select("lang", "source", "term", "n", "n_lang", "g", "own", "total", "total_lang", "terms", "in_block", "block", "block_a", "block_b")
    partial = both.groupBy("lang", "block", "block_a", "block_b").applyInArrow(lambda tile: compare(tile, top), TILES)
    found = partial.groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    there, back = F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    sides = F.explode(F.when(F.col("part") == "pair", F.array(there, back)).otherwise(F.array(there)))
    found = found.select("lang", "part", sides.alias("side"), "value").select("lang", "side.source", "part", "side.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    share = "1 + CAST(1000000000 AS HUGEINT) * ({n} + 2) // ({total} + 2 * v)"
    return rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {share.format(n="coalesce(c.n, 0)", total="s.total")} AS p, {share.format(n="n_lang", total="total_lang")} AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""

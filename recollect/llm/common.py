"""Helpers that the operators share: staged tables, word splitting, hashing, mergeable sketches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _steady_memory() -> None:
    """Freed arrays go back to the system: large blocks are mapped one by one, and Arrow keeps no pool of its own. Without this a Python
    worker that is used again and again holds its largest stage's memory."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 12 << 20)  # M_MMAP_THRESHOLD: above what a slice of texts takes
        libc.mallopt(-1, 48 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):
        pass  # another C library


_steady_memory()

#: Odd 64-bit multipliers of the shingle mix (from the fractional digits of pi).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


_left: set[str] = set()


def _sweep() -> None:
    """Deletes staged tables that nobody dropped, when the driver's Python ends."""
    from pyspark import SparkContext

    if _left and SparkContext._jvm is not None:
        for path in _left:
            p = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(SparkContext._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


atexit.register(_sweep)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where that is unset, a temporary folder of a local
    session, as in tests; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="recollect-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/recollect-{label}-{uuid.uuid4().hex}"


def staged(spark: SparkSession, df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_path(spark, label)
    _left.add(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def drop_staged(spark: SparkSession, *dfs: DataFrame) -> None:
    """Deletes staged tables that no later plan reads, and lets Spark's cleaner drop the shuffle files of finished plans."""
    for df in dfs:
        if path := getattr(df, "_staged_path", None):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _left.discard(path)
    gc.collect()
    spark._jvm.System.gc()


#: The space and the five ASCII controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The low 0 to 8 bytes of a number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
LONG_WORD = 64


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and each text's bounds in them; null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def byte_blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a little-endian number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes, 8 bytes a step; runs of the same length up to 8 bytes never collide. Long ones go to xxhash."""
    size = end - start
    h = size.astype(np.uint64) * MIX[0]
    blocks, at, live = byte_blocks(data), start, np.flatnonzero(size <= LONG_WORD)
    here, left, now = at[live], size[live], h[live]
    while len(live):
        now = finish((now ^ (blocks[here] & LOW_BYTES[np.minimum(left, 8)])) * MIX[1])
        h[live] = now
        more = np.flatnonzero(left > 8)
        live, here, left, now = live[more], here[more] + 8, left[more] - 8, now[more]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h


class Words:
    """Words of a batch of texts: maximal runs of bytes outside SPACE. `hashes` and byte bounds `start`, `end` of all words;
    text i has words first[i] to first[i + 1]. With `lower`, A-Z count as a-z in the hashes. Memory: some bytes a byte of text
    and some numbers a word."""

    def __init__(self, col: pa.Array, lower: bool = False):
        self.data, self.offsets = text_buffer(col)
        n = len(self.data)
        space = SPACE[self.data]
        bound = np.zeros(n + 1, bool)
        bound[self.offsets] = True
        starts = ~space
        starts[1:] &= space[:-1] | bound[1:n]
        self.start = np.flatnonzero(starts)
        ends = ~space
        ends[:-1] &= space[1:] | bound[1:n]
        self.end = np.flatnonzero(ends) + 1
        self.hashes = run_hashes(LOWER[self.data] if lower else self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def finish(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by their words' hashes; empty if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = finish((out + h[i : len(h) - n + 1 + i]) * MIX[i % len(MIX)])
    return out


def grams_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes(h, n) at some places."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = finish((out + h[at + i]) * MIX[i % len(MIX)])
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    """Ascending, each value once."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_sets(found: Words, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles, ascending; with fewer words its whole sequence as one; none without words."""
    grams, out = gram_hashes(found.hashes, n), []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        out.append(distinct(grams[a : b - n + 1]) if b - a >= n else gram_hashes(found.hashes[a:b], b - a) if b > a else grams[:0])
    return out


def chunks(batch: pa.RecordBatch, rows: int = 256, most: int = 1 << 20, text: int = 1):
    """Slices of some rows and, as far as single rows allow, some bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        some = np.cumsum(sizes[at : at + rows])
        n = max(1, int(np.searchsorted(some, most, "right")))
        yield batch.slice(at, min(n, len(some)))
        at += min(n, len(some))


# Mergeable arrays of fixed size: each task fills one, packs it in blocks, and blocks are summed or or-ed.

BLOCKS = 32
SKETCH_SCHEMA = "block int, data binary"


def pack_array(a: np.ndarray):
    """Rows (block, data) of one task's array."""
    parts = np.split(a, BLOCKS)
    return pa.record_batch({"block": pa.array(range(BLOCKS), pa.int32()), "data": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})


def merge_arrays(df: DataFrame, dtype: str, how: str) -> np.ndarray:
    """Merges the tasks' arrays by block on the executors; the driver gets one array, whose size is a parameter, not the data's."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(1):
                part = np.frombuffer(zlib.decompress(data.as_py()), dtype)
                if total is None:
                    total = part.copy()
                elif how == "sum":
                    total += part
                else:
                    total |= part
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = df.groupBy("block").applyInArrow(merge, SKETCH_SCHEMA).collect()
    if not rows:
        return np.empty(0, dtype)
    return np.concatenate([np.frombuffer(zlib.decompress(r["data"]), dtype) for r in sorted(rows, key=lambda r: r["block"])])


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, set at the top bits of the hashes (one long column)."""

    def run(batches):
        table = np.zeros((1 << bits) >> 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if table.any():
            yield pack_array(table)

    table = merge_arrays(hashes.mapInArrow(run, SKETCH_SCHEMA), "uint8", "or")
    return table if len(table) else np.zeros((1 << bits) >> 3, np.uint8)


def bits_set(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1


def beside(big: DataFrame, small: DataFrame, on, rows: int, most: int = 1 << 20, how: str = "inner") -> DataFrame:
    """A join that broadcasts `small`, whose rows are a few numbers and of which `rows` were counted, if these are `most` at
    most; else it shuffles."""
    return big.join(F.broadcast(small) if rows <= most else small, on, how)


def reserved(*taken: list[str]) -> str:
    """A prefix for column names of an operator's own, which no column in `taken` starts with."""
    names, k = [n.lower() for some in taken for n in some], 0
    while any(n.startswith(f"_r{k}_") for n in names):
        k += 1
    return f"_r{k}_"


def without(docs: DataFrame, ids: DataFrame, nulls: bool = False) -> DataFrame:
    """`docs`, all columns, without the rows whose doc_id is in `ids` (a stored table with doc_id); `nulls`: null is an id too."""
    name = reserved(docs.columns) + "id"
    gone = ids.select(F.col("doc_id").cast("long").alias(name))
    here = F.col("doc_id").cast("long")
    return beside(docs, gone, here.eqNullSafe(F.col(name)) if nulls else here == F.col(name), ids.count(), how="left_anti")


ARROW_ROWS = 1_000


def ids_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads; other columns, whatever their names, stay out of its plans. From here on at most
    ARROW_ROWS rows go to a Python worker at once: a batch of whole texts counts twice, in both processes."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))

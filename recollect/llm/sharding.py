"""Shards along a Hilbert curve over several metadata dimensions. DataFrame operations only.

Each dimension is quantised to a few bits: a category by a hash of its value, a size by its logarithm. The curve index of the
cell orders the rows, so a run of rows is a compact region of all dimensions, and files cut from runs can be pruned by minimum
and maximum of any of them. Within a cell rows are ordered by a hash of the text, so that equal texts stand together.

Law `rows`: the runs differ by one row at most. Rows are sorted once, by ranges of the whole key, so that no value is too
frequent to be split; a row's place is its place within its range plus the rows of the ranges before, of which there are as many
as tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm import common

BITS = 6


def curve_steps(dims: int) -> list[int]:
    """The curve as an automaton. State (e, d): the corner where the curve enters a cell and the axis along which it leaves. For
    state s = e * dims + d and the cell's corner c, entry s * 2**dims + c is next state * 2**dims + place of c along the curve."""
    size, mask = 1 << dims, (1 << dims) - 1
    turn = lambda x, k: (x << k % dims | x >> (dims - k % dims)) & mask
    gray = lambda x: x ^ x >> 1
    ungray = {gray(w): w for w in range(size)}
    ones = lambda x: (x ^ x + 1).bit_length() - 1  # noqa: E731  trailing ones
    out = []
    for e in range(size):
        for d in range(dims):
            for corner in range(size):
                w = ungray[turn(corner ^ e, dims - (d + 1) % dims)]
                entry = gray((w - 1) // 2 * 2) if w else 0
                axis = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % dims
                out.append(((e ^ turn(entry, d + 1)) * dims + (d + axis + 1) % dims) * size + w)
    return out


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place along the curve of a cell with coordinates of `bits` bits each."""
    dims = len(cells)
    steps = F.array(*(F.lit(x) for x in curve_steps(dims)))
    state, index = F.lit(0), F.lit(0).cast("long")
    for level in reversed(range(bits)):
        corner = F.lit(0)
        for k, c in enumerate(cells):
            corner = corner + F.shiftleft(F.shiftright(c, level).bitwiseAND(F.lit(1)), k)
        step = F.get(steps, state * (1 << dims) + corner)
        index = F.shiftleft(index, dims).bitwiseOR(step.bitwiseAND(F.lit((1 << dims) - 1)).cast("long"))
        state = F.shiftright(step, dims)
    return index


def category(c: Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int")


def magnitude(c: Column, bits: int = BITS) -> Column:
    """Three steps a doubling."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(c, F.lit(1))) * 3)).cast("int")


def placed(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32, law, shard, slot (gapless from 0 in each shard),
    grown_shard (null: the law is no function of the key), and the dimensions lang, source, curve. Null metadata is a value of
    its own, null text counts as empty, repeated rows are rows; an empty table has no shards. A very long text is one row of its
    size. Other columns of `docs` aren't read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("tie"),
        F.xxhash64(F.lit(1), raw).alias("tie2"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    same = rows.groupBy("tie", "tie2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lang", "source")).alias("head")).where("n > 1").select("tie", "tie2", "head")
    same = common.staged(spark, same, "equal-texts")
    rows = common.beside(rows, same, ["tie", "tie2"], same.count(), how="left")
    of_group = [F.when(F.col("head").isNull(), F.col(c)).otherwise(F.col(f"head.{c}")) for c in ("lang", "source")]
    curve = hilbert_index([*(category(c) for c in of_group), magnitude(F.col("size"))])
    keyed = common.staged(spark, rows.withColumn("curve", curve).drop("head"), "curve")
    common.drop_staged(spark, same)
    key = ["curve", "tie", "tie2", "doc_id", "lang", "source"]
    ordered = common.staged(spark, keyed.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id()), "ordered")
    common.drop_staged(spark, keyed)
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row a task of the sort
    ahead = common.staged(spark, sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total")), "ranges")
    n, s = F.col("total"), F.lit(shards)
    out = ordered.withColumn("part", part).join(F.broadcast(ahead), "part")
    out = out.withColumn("rank", F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    out = out.withColumn("shard", F.expr(f"rank * {shards} DIV total"))
    slot = F.col("rank") - F.expr(f"(shard * total + {shards - 1}) DIV {shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "lang", "source", "curve")


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, shards: int = 16) -> None:
    """Writes `docs` with all their columns as Parquet, a folder a shard (`_shard`, or a name that no column has), rows in the order
    of their slots. Repeated rows (equal doc_id and text) are told apart by number, so each is written once."""
    folder_of = "_shard" if "_shard" not in docs.columns else common.reserved(docs.columns) + "shard"
    key = ["doc_id", "text_crc32", "copy"]
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy(F.lit(0)))
    place = placed(spark, docs, shards).withColumn("copy", copy).select(*key, "shard", "slot")
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("text_crc32")).withColumn("copy", copy)
    same = [named[k].eqNullSafe(place[k]) for k in key]
    both = named.join(place, same).select("row", "shard", "slot")
    both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(folder_of)).write.partitionBy(folder_of).parquet(folder)

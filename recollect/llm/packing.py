"""Best-fit packing of token sequences into bins of a fixed capacity (large-item matching).

The packing depends on lengths alone, and there are at most `capacity` of them. So Spark counts the pieces of each length,
the driver packs that histogram (its size never grows with the data), and the plan goes back to the rows by a join on
length and rank. Ranks within a length are counted in buckets, so that a length which a third of the rows share is spread
over many tasks.

Packing: every item over a third of the capacity is large, and a bin holds two of those at most. The largest one left is
matched with the largest that fits beside it. Smaller items, in descending length, go to the bin with the least room that
is enough, and open a bin where there is none.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm import common, tokens

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, from_rank long, n long, first_bin long, offset long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: a document's ids and the end id, cut into `capacity` where longer. Null text counts as empty (one piece,
    the end id); a null doc_id and repeated rows are kept as they are. `with_ids` adds the ids as binary."""
    schema = PIECES + (", ids binary" if with_ids else "")
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches):
        enc = tokens.encoder(tokenizer_path)
        for whole in batches:
            for batch in common.chunks(whole):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1)), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names[: len(cols)])

    return common.ids_and_text(docs).mapInArrow(cut, schema)


class Bins:
    """Runs of equal bins by the room they have left: room -> [(first bin, bins)]."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.slots: list[tuple[int, int, int, int, int]] = []

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.runs:
                bisect.insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((first, n))

    def open(self, n: int) -> tuple[int, int]:
        first, self.opened = self.opened, self.opened + n
        return first, n

    def put(self, length: int, rank: int, n: int, first: int, offset: int) -> None:
        self.slots.append((length, rank, n, first, offset))

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.pop(bisect.bisect_left(self.rooms, room))
        return run


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, n, first bin, offset) for a histogram of lengths, and the number of bins. A slot puts n
    items of one length, by rank, into n consecutive bins at one offset."""
    bins, left = Bins(capacity), {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):  # matching
        while n := left[length]:
            at = bisect.bisect_right(large, capacity - length) - 1
            while at >= 0 and not (left[large[at]] - (large[at] == length)) > 0:
                at -= 1
            mate = large[at] if at >= 0 else 0
            pairs = (n // 2 if mate == length else min(n, left[mate])) if mate else 0
            first, k = bins.open(pairs or n)
            bins.put(length, used[length], k, first, 0)
            used[length] += k
            left[length] -= k
            if pairs:
                bins.put(mate, used[mate], k, first, length)
                used[mate] += k
                left[mate] -= k
            bins.add(capacity - length - (mate if pairs else 0), first, k)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):  # best fit
        while n := left[length]:
            at = bisect.bisect_left(bins.rooms, length)
            if at == len(bins.rooms):
                bins.add(capacity, *bins.open(max(1, n * length // capacity)))
                continue
            room = bins.rooms[at]
            first, k = bins.take(room)
            each = min(room // length, n)
            full = min(k, n // each)
            for i in range(each):
                bins.put(length, used[length] + i * full, full, first, capacity - room + i * length)
            used[length] += each * full
            left[length] -= each * full
            bins.add(room - each * length, first, full)
            bins.add(room, first + full, k - full)
    return bins.slots, bins.opened


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to `pieces` (any columns, among them `length`, 1 to capacity, and those of `order`, which
    decide the rank among pieces of one length, nulls first; equal ones in any order). `pieces` is read more than once: pass a stored
    table. Its other columns may have any names but n_buckets, bucket, rank and ahead."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    slots, _ = plan(counts, capacity)
    each = max(256, sum(counts.values()) >> 16)  # so there are at most 2**16 + capacity buckets
    shares = spark.createDataFrame([(k, -(-v // each)) for k, v in counts.items()] or [(0, 1)], "length long, n_buckets long")
    bucket = F.pmod(F.xxhash64(*order), F.col("n_buckets"))
    keyed = pieces.join(F.broadcast(shares), "length").withColumn("bucket", bucket).drop("n_buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = keyed.withColumn("rank", F.row_number().over(within)).join(F.broadcast(starts), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("ahead")).drop("ahead", "bucket")
    places = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], SLOTS).withColumnRenamed("length", "slot_length"))
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n"))
    out = ranked.join(places, here)
    return out.withColumn("sequence_id", F.col("first_bin") + F.col("rank") - F.col("from_rank")).select(*pieces.columns, "sequence_id", "offset")


def best_fit(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs every document, a row a piece. An empty table gives no rows; null and empty texts are a piece of the end id alone; null ids
    and repeated rows are packed like others; only texts longer than a sequence are cut, however long they are. Other columns of `docs`
    aren't read."""
    return pack(spark, common.staged(spark, token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)

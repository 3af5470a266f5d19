"""Document fingerprints: bottom-k sketches of the hashes of 12-character shingles.

A fingerprint holds the k least hash values of a text's distinct shingles, in 48 bits each, ascending, as base64. The sketch of
a union is the k least values of both (`merge`), so parts of a text or corpus can be sketched apart. From sketches come the
number of distinct shingles, resemblance and containment. A text shorter than a shingle is one shingle, an empty text none.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common

K, WIDTH, BYTES = 128, 12, 6
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, np.uint64)
BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE modulo 2**64 and their inverses, from exponent 0; kept by the worker for the largest n so far."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def char_shingles(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Hashes of each text's runs of `width` code points (repeats included)."""
    data, bounds = common.text_buffer(pa.array(texts, pa.large_string()))
    n = len(data)
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[:n], out=total[1:])
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)
    first = np.searchsorted(at, bounds)
    whole = np.empty(0, np.uint64)
    if len(at) > width:
        a, b = at[:-width], at[width:]
        whole = common.finish((total[b] - total[a]) * inverse[a])
    out = []
    for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if y - x >= width:
            out.append(whole[x : y - width + 1])
        elif y > x:
            out.append(common.finish((total[at[y : y + 1]] - total[at[x : x + 1]]) * inverse[at[x : x + 1]]))
        else:
            out.append(whole[:0])
    return out


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct values, in 48 bits."""
    if len(hashes) > 16 * k:  # the least values of a long text lie under this bound, or else it is dropped
        few = hashes[hashes < np.uint64(int(4 * k / len(hashes) * 2.0**64))]
        if len(found := common.distinct(few >> np.uint64(16))) >= k:
            return found[:k]
    return common.distinct(hashes >> np.uint64(16))[:k]


def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    return [bottom(h, k) for h in char_shingles(texts)]


def dump(sketch: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :]).tobytes()).decode()


def load(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BYTES :] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return common.distinct(np.concatenate((a, b)))[:k]


def count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact under k, else from the k-th least value."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / (float(sketch[-1]) + 1) * 2.0 ** (8 * BYTES)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common values among the k least of both: the Jaccard similarity. Two empty texts are alike."""
    both = np.concatenate((a, b))
    if not len(both):
        return 1.0
    both = np.sort(both)
    same = both[1:][both[1:] == both[:-1]]
    union = common.distinct(both)[:k]
    return float(np.searchsorted(same, union[-1], "right")) / len(union)


def contained(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of a that b has."""
    if not len(a):
        return 1.0
    union = count(merge(a, b, k), k)
    return min(1.0, max(0.0, resemblance(a, b, k) * union / count(a, k)))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and fingerprint of every row; null text is empty, null ids and repeated rows stay as they are, very long texts are taken whole, an
    empty table gives no rows."""

    def run(batches):
        for whole in batches:
            for batch in common.chunks(whole):
                made = [dump(s) for s in sketches([t or "" for t in batch.column(1).to_pylist()], k)]
                yield pa.record_batch([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return common.ids_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, doc_id, text), partitioned by bucket and sorted by (bucket, extra, doc_id, a hash of the text). Buckets are
    ranges of doc_id, and of the hash within an id that many rows share; each also holds the first row of the next bucket, marked
    extra (the last one the very first row). So every row's successor stands right behind it, in one shuffle of the texts. Null ids
    come first."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = common.ids_and_text(docs).withColumn("key", key.cast("double")).withColumn("tie", F.xxhash64("text"))
    n = min(20_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] or []
    hot = {c: k + 1 for c, k in Counter(cuts).items() if k > 1}  # an id that several cuts fall on, and in how many parts it is cut
    splits = [float("-inf"), *(sorted({*cuts, *(math.nextafter(c, math.inf) for c in hot)}) or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="key", outputCol="range").transform(rows)
    parts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in hot.items() for x in pair)), F.col("key")), F.lit(1)) if hot else F.lit(1)
    part = F.least(parts - 1, F.floor((F.col("tie") / 2.0**64 + 0.5) * parts).cast("int"))
    dealt = dealt.withColumn("at", F.struct(F.col("range").cast("int").alias("range"), part.alias("part")))
    place = F.struct(key.alias("id"), "tie")
    first = sorted((tuple(r["at"]), tuple(r["first"])) for r in dealt.groupBy("at").agg(F.min(place).alias("first")).collect())  # a row a bucket
    numbers = spark.createDataFrame([(*at, i) for i, (at, _) in enumerate(first)], "range int, part int, bucket int")
    heads = spark.createDataFrame([(*head, (i - 1) % len(first)) for i, (_, head) in enumerate(first)], "id long, head long, before int")
    keyed = dealt.select("doc_id", "text", "tie", key.alias("id"), F.col("at.range").alias("range"), F.col("at.part").alias("part"))
    keyed = keyed.join(F.broadcast(numbers), ["range", "part"]).join(F.broadcast(heads), (keyed["id"] == heads["id"]) & (F.col("tie") == F.col("head")), "left")  # a row a bucket
    here = F.array(F.struct("bucket", F.lit(False).alias("extra")))
    both = F.when(F.col("before").isNotNull(), F.concat(here, F.array(F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))))).otherwise(here)
    spread = keyed.select("doc_id", "text", "tie", F.explode(both).alias("b")).select("b.bucket", "b.extra", "doc_id", "text", "tie")
    return spread.repartition("bucket").sortWithinPartitions("bucket", "extra", "doc_id", "tie").select("bucket", "extra", "doc_id", "text")


def edited(spark: SparkSession, docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document's. Null text is empty; rows with null doc_id come first; rows that share a doc_id are in the
    order of a hash of their text; a table of one row is its own next, an empty table gives no rows. Very long texts are taken whole;
    other columns of `docs` aren't read."""

    def finished(rows: list[tuple], ahead: tuple):
        texts = [r[1] for r in rows]
        edits = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, [*texts[1:], ahead[1]], strict=True)]
        own = sketches([*texts, ahead[1]], k)
        new = sketches(edits, k)
        cols = (
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits]),
            pa.array([dump(s) for s in own[:-1]]),
            pa.array([dump(s) for s in new]),
            pa.array([resemblance(a, b, k) for a, b in zip(own, new, strict=False)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        )
        return pa.record_batch(list(cols), names=[x.split()[0] for x in OUT.split(", ")])

    def run(batches):
        rows: list[tuple] = []  # of one bucket, each waiting for the row behind it
        size, closed = 0, None
        for whole in batches:
            for batch in common.chunks(whole, text=3):
                for bucket, extra, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    text = text or ""
                    if extra:
                        if closed != bucket:  # the least of the next bucket's first rows
                            yield finished(rows, (doc, text))
                            rows, size, closed = [], 0, bucket
                        continue
                    if len(rows) >= 256 or size > 2 << 20:
                        yield finished(rows, (doc, text))
                        rows, size = [], 0
                    rows.append((doc, text))
                    size += len(text)

    return in_order(spark, docs).mapInArrow(run, OUT)

"""Token ids in sorted-string-table shards.

Shard file: data blocks, Bloom filter, block index, footer. All integers are little-endian.

* Key: the identifier as 8 big-endian bytes with the sign bit flipped, so byte order is number order; empty for null.
* Block: entries in key order, then the offsets of its restart points (4 bytes each), their number (4), crc32 of all that (4).
  Entry: varints shared, unshared, value length; then the key's unshared end and the value. `shared` bytes are those of the
  entry before; at a restart point (every 16th entry) it is 0. Value: bytes an id (1 byte, 2 or 4), then the ids.
* Bloom filter: number of probes (1 byte), then the bits; 10 bits a key.
* Index: per block its last key's length (1 byte), the last key, offset (8) and length (8).
* Footer, 68 bytes: offset and length of filter and index (8 each), entries (8), tokens (8), blocks (8), crc32 of filter and
  index (4), magic (8).

Documents are dealt by ranges of the identifier and written while they stream by in order; a shard is closed at
`shard_bytes`, so memory is bounded by a block, an index and a filter. A file gets its final name after its last byte, with a
name of its own per attempt; only files that a finished task reports are in the manifest, so a retried task does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common, tokens

END_ID = 0
MAGIC = b"RCSST\x00\x00\x01"
RESTART, BLOCK_BYTES, SHARD_BYTES, BITS_A_KEY, PROBES = 16, 64 << 10, 64 << 20, 10, 7
FOOTER = struct.Struct("<7QI8s")
MANIFEST = "path string, first_key binary, last_key binary, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int, n: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    step = (h >> 33) | 1
    return [(h + i * step) % bits for i in range(n)]


def pack_ids(ids: bytes) -> bytes:
    """32-bit ids as a value: in 16 bits each where all fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def unpack_ids(value: bytes) -> bytes:
    return value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()


class Writer:
    """Writes one shard; add() keys in order, then close()."""

    def __init__(self, path: str, block_bytes: int = BLOCK_BYTES):
        self.block_bytes = block_bytes
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".tmp")
        self.index: list[tuple[bytes, int, int]] = []
        self.hashed: list[bytes] = []
        self.at = self.n_tokens = 0
        self.first = self.last = b""
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def add(self, key: bytes, ids: bytes) -> None:
        value = pack_ids(ids)
        if not self.hashed:
            self.first = key
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.hashed.append(key)
        self.n_tokens += len(ids) // 4
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        data += struct.pack("<I", zlib.crc32(data))
        self.out.write(data)
        self.index.append((self.last, self.at, len(data)))
        self.at += len(data)
        self._fresh()

    def close(self) -> tuple:
        self._flush()
        size = max(64, len(self.hashed) * BITS_A_KEY + 7 & ~7)
        bits = np.zeros(size, np.uint8)
        for key in self.hashed:
            bits[probes(key, size, PROBES)] = 1
        bloom = bytes([PROBES]) + np.packbits(bits, bitorder="little").tobytes()
        index = b"".join(bytes([len(k)]) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        tail = FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), len(self.hashed), self.n_tokens, len(self.index), zlib.crc32(bloom + index), MAGIC)
        self.out.write(bloom + index + tail)
        self.out.close()
        self.fs.move(self.path + ".tmp", self.path)
        return self.first, self.last, len(self.hashed), self.n_tokens, self.at + len(bloom) + len(index) + len(tail)


class Reader:
    """Reads one shard by blocks: items() in order, get(key) by filter, index and restart points."""

    def __init__(self, path: str):
        system, inside = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inside)
        size = self.file.size()
        b_at, b_n, i_at, i_n, self.n_docs, self.n_tokens, blocks, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        self.bloom, index = self.file.read_at(b_n, b_at), self.file.read_at(i_n, i_at)
        if magic != MAGIC or crc != zlib.crc32(self.bloom + index):
            raise ValueError(f"{path} is no whole shard")
        self.index, at = [], 0
        for _ in range(blocks):
            n = index[at]
            self.index.append((index[at + 1 : at + 1 + n], *struct.unpack_from("<QQ", index, at + 1 + n)))
            at += 17 + n
        self.keys = [k for k, _, _ in self.index]

    def close(self) -> None:
        self.file.close()

    def _block(self, k: int) -> tuple[bytes, tuple[int, ...], int]:
        _, at, n = self.index[k]
        data = self.file.read_at(n, at)
        if zlib.crc32(data[:-4]) != struct.unpack_from("<I", data, n - 4)[0]:
            raise ValueError(f"block {k} is damaged")
        count = struct.unpack_from("<I", data, n - 8)[0]
        end = n - 8 - 4 * count
        return data, struct.unpack_from(f"<{count}I", data, end), end

    @staticmethod
    def _entry(data: bytes, at: int, before: bytes) -> tuple[bytes, bytes, int]:
        shared, at = read_varint(data, at)
        unshared, at = read_varint(data, at)
        size, at = read_varint(data, at)
        key = before[:shared] + data[at : at + unshared]
        return key, data[at + unshared : at + unshared + size], at + unshared + size

    def items(self):
        for k in range(len(self.index)):
            data, _, end = self._block(k)
            at, key = 0, b""
            while at < end:
                key, value, at = self._entry(data, at, key)
                yield key, unpack_ids(value)

    def may_have(self, key: bytes) -> bool:
        bits = (len(self.bloom) - 1) * 8
        return all(self.bloom[1 + (p >> 3)] >> (p & 7) & 1 for p in probes(key, bits, self.bloom[0]))

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key (repeated rows have several)."""
        if not self.may_have(key):
            return []
        found: list[bytes] = []
        for k in range(bisect_left(self.keys, key), len(self.index)):
            data, restarts, end = self._block(k)
            low, high = 0, len(restarts) - 1
            while low < high:  # the last restart point below the key
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self._entry(data, restarts[mid], b"")[0] < key else (low, mid - 1)
            at, now = restarts[low], b""
            while at < end:
                now, value, at = self._entry(data, at, now)
                if now > key:
                    return found
                if now == key:
                    found.append(unpack_ids(value))
        return found


def write(spark: SparkSession, docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encodes every document, ends it with `end_id` and writes shards under `folder` (a URI that executors and driver
    share). Returns the manifest, a row a shard. Null text counts as empty, null doc_id sorts first, repeated ids stay side
    by side; an empty table makes no shard."""
    end = end_id.to_bytes(4, "little")

    def pour(batches):
        enc, writer, path = tokens.encoder(tokenizer_path), None, ""

        def done():
            row = (path, *writer.close())
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "first_key", "last_key", "n_docs", "n_tokens", "n_bytes"])

        for whole in batches:
            for batch in common.chunks(whole):
                for doc, ids in zip(batch.column(0).to_pylist(), enc.ids(batch.column(1)), strict=True):
                    if writer is None:
                        path = f"{folder}/{uuid.uuid4().hex}.sst"
                        writer = Writer(path, block_bytes)
                    writer.add(key_of(doc), ids + end)
                    if writer.at >= shard_bytes:
                        yield done()
                        writer = None
        if writer is not None:
            yield done()

    keyed = common.ids_and_text(docs).withColumn("tie", F.xxhash64("text"))
    sorted_docs = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return common.staged(spark, sorted_docs.mapInArrow(pour, MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Reads every shard of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. The driver adds
    up one number a shard."""
    shards = sorted(manifest.select("path", "first_key", "last_key", "n_tokens").collect(), key=lambda r: (bytes(r["first_key"]), bytes(r["last_key"]), r["path"]))
    rows, at = [], 0
    for r in shards:
        rows.append((r["path"], at))
        at += r["n_tokens"]

    def scan(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, at = Reader(path), start
                out: list[tuple] = []
                for key, value in reader.items():
                    out.append((id_of(key), at, len(value) // 4, zlib.crc32(value)))
                    at += len(value) // 4
                reader.close()
                for k in range(0, len(out), 10_000):
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out[k : k + 10_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not rows:
        return spark.createDataFrame([], ROWS)
    tasks = spark.sparkContext.parallelize(rows, len(rows)).toDF("path string, start long")  # a task a shard
    return tasks.mapInArrow(scan, ROWS)


def lookup(spark: SparkSession, manifest: DataFrame, ids: list[int]) -> dict[int, list[bytes]]:
    """Values of a few identifiers: the manifest's key ranges choose the shards, each shard its filter, index and block."""
    found: dict[int, list[bytes]] = {}
    for doc in ids:
        key = key_of(doc)
        for r in manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).collect():
            reader = Reader(r["path"])
            if values := reader.get(key):
                found.setdefault(doc, []).extend(values)
            reader.close()
    return found


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes all documents and reads them back. The shards are read when the result is, and deleted when the driver's Python ends."""
    folder = common.new_path(spark, "sst")
    common._left.add(folder)
    return read(spark, write(spark, docs, tokenizer_path, folder, end_id))

"""WARC archives of web pages: written in segments, read back by reassembling them.

Writing. A page is an HTTP response with its body in chunked transfer framing. A record whose block is longer than `segment_bytes` is cut
into segments: the first has WARC-Segment-Number 1, each other is a `continuation` with WARC-Segment-Origin-ID and its number, and
the last one has WARC-Segment-Total-Length. Of equal payloads of at least `least_bytes`, the one with the largest page_id is written whole, the others are
`revisit` records that refer to it. Each record is a gzip member of its own, with digests of payload and block. An archive is closed at
`archive_bytes`, wherever in a record that is, so continuations may lie in another archive than their origin.

Reading. Archives are read record by record. Unsegmented records are decoded where they are read; segments are dealt by origin, ordered by number, and
decoded in a stream: numbers have to be gapless, lengths have to add up to the total, chunks have to end, digests have to agree. A
task holds one segment and what it decodes to. Revisits are resolved by a join over the distinct records they refer to.

Files get their final name after their last byte, and a name of its own per attempt; only those that a finished task reports are in the manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common

LEAST_BYTES, SEGMENT_BYTES, ARCHIVE_BYTES, CHUNK_BYTES, TASK_BYTES = 1000, 16 << 10, 256 << 20, 4 << 10, 128 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"
ABOUT = "record_id string, record_type string, page_id long, url string, refers_to_id string, payload_bytes long, payload_digest string, problem string"
SEGMENTS = ABOUT + ", payload binary, number int, total long, block binary"

# Names of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
END = b"\r\n\r\n"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def hex_of(field: str | None) -> str | None:
    """Hex of a digest field in base32 or hex; None for another algorithm."""
    if not field or not field.lower().startswith("sha1:"):
        return None
    value = field[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def field_text(value: str) -> str:
    """A header value; one that a header can't hold as it is becomes an encoded word."""
    if re.search(r"[\r\n]|^\s|\s$|^=\?|^$", value):
        return f"=?utf-8?B?{base64.b64encode(value.encode()).decode()}?="
    return value


def text_field(value: str | None) -> str | None:
    if value and value.startswith("=?utf-8?B?") and value.endswith("?="):
        return base64.b64decode(value[10:-2]).decode()
    return value


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


class Archive:
    """One archive file; a record is a gzip member."""

    def __init__(self, path: str):
        self.uri = path
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".tmp", compression=None)
        self.at = self.n = 0

    def add(self, fields: list[tuple[str, object]], block: bytes) -> None:
        fields = [*fields, ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())), ("Content-Length", len(block))]
        head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
        pack = zlib.compressobj(1, wbits=31)
        data = pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END) + pack.flush()
        self.out.write(data)
        self.at += len(data)
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(self.path + ".tmp", self.path)
        return self.uri, self.n, self.at


class Dechunked:
    """Payload of an HTTP message, fed in pieces of any size. `done` after its last chunk; a message without chunked framing is done when
    the input ends."""

    def __init__(self, keep: bool):
        self.sha, self.size, self.kept = hashlib.sha1(), 0, [] if keep else None
        self.state, self.left, self.rest, self.done = "head", 0, b"", False

    def take(self, data) -> None:
        self.sha.update(data)
        self.size += len(data)
        if self.kept is not None:
            self.kept.append(bytes(data))

    def feed(self, data: bytes) -> None:
        data, at = self.rest + data, 0
        view, self.rest = memoryview(data), b""
        while at < len(data):
            if self.state == "head":
                end = data.find(END, at)
                if end < 0:
                    break
                framed = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", data[at : end + 2])
                self.state, at = "size" if framed else "plain", end + 4
            elif self.state == "plain":
                self.take(view[at:])
                at = len(data)
            elif self.state == "data":
                part = view[at : at + self.left]
                self.take(part)
                at, self.left = at + len(part), self.left - len(part)
                if not self.left:
                    self.state = "after"
            else:
                end = data.find(b"\r\n", at)
                if end < 0:
                    break
                line, at = data[at:end], end + 2
                if self.state == "after":
                    if line:
                        raise ValueError("a chunk is longer than its size says")
                    self.state = "size"
                elif self.state == "size":
                    digits = line.split(b";")[0].strip()
                    if not re.fullmatch(rb"[0-9a-fA-F]+", digits):
                        raise ValueError("a chunk has no size")
                    self.left = int(digits, 16)
                    self.state = "data" if self.left else "trailer"
                elif self.state == "trailer" and not line:
                    self.state, self.done = "over", True
                elif self.state == "over":
                    raise ValueError("bytes follow the last chunk")
        self.rest = data[at:]

    def end(self) -> None:
        if self.state == "plain":
            self.done = True
        if not self.done or self.rest:
            raise ValueError("the message ends early")


class Assembly:
    """Segments of one record, in the order of their numbers."""

    def __init__(self, first: dict, keep: bool):
        self.row, self.message, self.next, self.length, self.total, self.problem = first, Dechunked(keep), 1, 0, None, None

    def add(self, number: int, block: bytes, total: int | None) -> None:
        if self.problem:
            return
        try:
            if number != self.next or self.total is not None:
                raise ValueError(f"segment {self.next} is missing" if number > self.next and self.total is None else f"segment {number} is there twice")
            self.next, self.length, self.total = number + 1, self.length + len(block), total
            self.message.feed(block)
        except ValueError as e:
            self.problem = str(e)

    def end(self) -> dict:
        row = dict(self.row, number=None, total=None, block=None, payload=None, payload_bytes=None)
        claimed, row["payload_digest"] = row["payload_digest"], None
        try:
            if self.problem:
                raise ValueError(self.problem)
            if self.total is None:
                raise ValueError("the last segment is missing")
            if self.total != self.length:
                raise ValueError(f"the segments have {self.length} bytes, not {self.total}")
            self.message.end()
            digest = self.message.sha.hexdigest()
            if claimed not in (None, digest):
                raise ValueError("the payload has another digest")
            row["payload_bytes"], row["payload_digest"] = self.message.size, digest
            if self.message.kept is not None:
                row["payload"] = b"".join(self.message.kept)
        except ValueError as e:
            row["problem"] = str(e)
        return row


def records(file):
    """(fields by lower-case name, block) of each record of an open archive."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        fields, name = {}, ""
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            if line[:1] in b" \t" and name:
                fields[name] += " " + line.decode().strip()
                continue
            name, _, value = line.decode().partition(":")
            name = name.strip().lower()
            fields.setdefault(name, value.strip())
        size = int(fields["content-length"])
        block = file.read(size)
        if len(block) != size:
            raise ValueError("an archive ends early")
        yield fields, block


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


BLOCK = 11  # place of the column
ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SEGMENTS.split(", "))])


def row_of(fields: dict, block: bytes) -> dict:
    """A segment, or a record without segments (number 1, its own length as the total)."""
    kind, number, total = fields.get("warc-type"), fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    page, problem = fields.get("x-page-id"), None
    digest = hex_of(fields.get("warc-block-digest"))
    if digest not in (None, hashlib.sha1(block).hexdigest()):
        problem = "the block has another digest"
    return {
        "record_id": fields.get("warc-segment-origin-id") if kind == "continuation" else fields.get("warc-record-id"),
        "record_type": kind,
        "page_id": int(page) if page is not None else None,
        "url": text_field(fields.get("warc-target-uri")),
        "refers_to_id": fields.get("warc-refers-to"),
        "payload_bytes": None,
        "payload_digest": hex_of(fields.get("warc-payload-digest")),
        "problem": problem,
        "payload": None,
        "number": int(number) if number else None,
        "total": int(total) if total else None,
        "block": block,
    }


def write(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of `pages` under `folder` (a URI that executors and driver share) and returns the manifest, a row an archive."""
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    common.small_batches(spark)
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload")).withColumn("tag", F.monotonically_increasing_id())
    rows = common.staged(spark, rows, "pages")
    same = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.struct("page_id", (-F.col("tag")).alias("tag"))).alias("head"))
    same = common.staged(spark, same.where("n > 1").select("digest", "size", "n", (-F.col("head.tag")).alias("head")), "equal-pages")
    given = beside_groups(rows, same, ["digest", "size"], "head")
    revisit = F.col("head") != F.col("tag")
    given = given.select("page_id", "url", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"), "digest", "size", "tag", F.when(revisit, F.col("head")).alias("head"))

    def pour(batches):
        out = None

        def name(tag: int) -> str:
            return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}/{tag}')}>"

        def room() -> Archive:
            return out or Archive(f"{folder}/{uuid.uuid4().hex}.warc.gz")

        def done(closed: Archive):
            return pa.record_batch([pa.array([x]) for x in closed.close()], names=["path", "n_records", "n_bytes"])

        rows = (row for whole in batches for part in common.chunks(whole, text=2) for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        for page, url, payload, digest, size, tag, head in rows:
            about = [("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else field_text(url)), ("X-Page-Id", page), ("Content-Type", "application/http; msgtype=response")]
            about.append(("WARC-Payload-Digest", base32(bytes.fromhex(digest))))
            if head is not None:
                out = room()
                out.add([("WARC-Type", "revisit"), ("WARC-Record-ID", name(tag)), ("WARC-Refers-To", name(head)), ("WARC-Profile", PROFILE), *about], HTTP + b"Content-Length: %d" % size + END)
                continue
            block = HTTP + b"Transfer-Encoding: chunked" + END + chunked(payload)
            cuts = range(0, len(block), segment_bytes)
            for k, at in enumerate(cuts, 1):
                out = room()
                part, last = block[at : at + segment_bytes], k == len(cuts)
                if k == 1:
                    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name(tag)), *about, ("WARC-Segment-Number", None if last else 1)]
                else:
                    fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(tag)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if last else None)]
                out.add(fields, part)
                if out.at >= archive_bytes:
                    yield done(out)
                    out = None
        if out is not None:
            yield done(out)

    manifest = common.staged(spark, given.mapInArrow(pour, MANIFEST), "warc-manifest")
    common.drop_staged(spark, rows, same)
    return manifest


def beside_groups(rows: DataFrame, groups: DataFrame, on: list[str], *more: str, most: int = 1 << 20) -> DataFrame:
    """Left join of stored rows with stored groups (`n`: rows of the group). `most` groups or fewer are broadcast. Of more, those with over
    1/65536 of the rows are broadcast, which are fewer than 65536, and the rest is shuffled, so that no key is hot there."""
    named = groups.select(*on, "n", *more)
    if groups.count() <= most:
        return rows.join(F.broadcast(named.drop("n")), on, "left")
    bar = rows.count() >> 16
    hot, cold = named.where(F.col("n") > bar), named.where(F.col("n") <= bar).drop("n")
    spread, keyed = rows.join(F.broadcast(hot), on, "left"), F.lit(True)
    for c in on:
        keyed &= F.col(c).isNotNull()
    cool = F.col("n").isNull() & keyed
    return spread.where(~cool).drop("n").unionByName(spread.where(cool).drop("n", *more).join(cold, on, "left"))


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """A row a record, segments put together: record_id, record_type, page_id, url, refers_to_id, payload (null unless `payloads`), payload_bytes,
    payload_digest (hex SHA-1, of a revisit the one that it claims), problem (null for a whole record; a broken one has null payload, bytes and digest)."""
    sizes = manifest.agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).first()
    tasks = max(1, min(sizes["n"], max(spark.sparkContext.defaultParallelism, -(-(sizes["b"] or 0) // task_bytes))))

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inside = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(inside, compression=None) as raw, gzip.GzipFile(fileobj=raw) as file:
                    for fields, block in records(file):
                        row = row_of(fields, block)
                        if row["record_type"] == "revisit":
                            row["block"] = None
                        elif row["record_type"] == "response" and row["number"] is None:
                            one = Assembly(row, payloads)
                            one.problem = row["problem"]
                            one.add(1, block, len(block))
                            row = one.end()
                        elif row["record_type"] not in ("response", "continuation"):
                            continue  # warcinfo, request, metadata and others hold no page
                        rows.append(row)
                        held += len(row["block"] or b"") + len(row["payload"] or b"")
                        if len(rows) >= 1000 or held >= 1 << 22:
                            yield batch_of(rows, ARROW)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows, ARROW)

    def join(batches):
        open_one: Assembly | None = None
        rows, held = [], 0
        for batch in batches:
            for row in (row for part in common.chunks(batch, text=BLOCK) for row in part.to_pylist()):
                if open_one is not None and row["record_id"] != open_one.row["record_id"]:
                    rows.append(open_one.end())
                    open_one = None
                if row["number"] is None:
                    rows.append(row)
                else:
                    if open_one is None:
                        open_one = Assembly(dict(row, record_type="response"), payloads)
                    open_one.problem = open_one.problem or row["problem"]
                    open_one.add(row["number"], row["block"], row["total"])
                held += len(row["block"] or b"") + len(row["payload"] or b"")
                if len(rows) >= 1000 or held >= 1 << 22:
                    if rows:
                        yield batch_of(rows, ARROW)
                    rows, held = [], 0
        if open_one is not None:
            rows.append(open_one.end())
        if rows:
            yield batch_of(rows, ARROW)

    found = manifest.select("path").repartition(tasks).mapInArrow(scan, SEGMENTS)
    return found.repartition("record_id").sortWithinPartitions("record_id", "number").mapInArrow(join, SEGMENTS).drop("number", "total", "block")


def resolved(spark: SparkSession, found: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, problem of stored records; a revisit has bytes and page of the response it
    refers to, where that is there and has the digest that the revisit claims."""
    asked = found.where("record_type = 'revisit'").groupBy("refers_to_id").agg(F.count("*").alias("n"))
    there = found.where("record_type = 'response' AND problem IS NULL").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("head_page"), F.col("payload_bytes").alias("head_bytes"), F.col("payload_digest").alias("head_digest"))
    heads = common.staged(spark, asked.join(there, "refers_to_id"), "referred")
    out = beside_groups(found.drop("payload"), heads, ["refers_to_id"], "head_page", "head_bytes", "head_digest")
    revisit = F.col("record_type") == "revisit"
    right = F.coalesce(F.col("head_digest") == F.col("payload_digest"), F.lit(False))
    return out.select(
        "page_id",
        "url",
        F.when(revisit & right, F.col("head_bytes")).when(~revisit, F.col("payload_bytes")).alias("payload_bytes"),
        F.when(~revisit | right, F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit & right, F.col("head_page")).alias("refers_to"),
        F.when(revisit & ~right, F.lit("it refers to no whole record with its digest")).otherwise(F.col("problem")).alias("problem"),
    )


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes all pages to archives, reads them back and resolves revisits.

    Null html is an empty payload; a null page_id is smaller than all others and comes back as null, as does a null url. Rows that share page_id and
    payload are told apart: one of them is the response, the others revisit it. A very long page is written and read in segments. An
    empty table makes no archive and gives no rows. Other columns of `pages` aren't read."""
    folder = common.new_path(spark, "warc")
    common._left.add(folder)  # archives are read when the result is, and deleted when the driver's Python ends
    found = common.staged(spark, read(spark, write(spark, pages, folder, least_bytes)), "records")
    return resolved(spark, found)


def oracle(least_bytes: int = LEAST_BYTES) -> str:
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, sha1(h) AS payload_digest, octet_length(encode(h)) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= {least_bytes} AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= {least_bytes} AND page_id < head THEN head END AS refers_to FROM s"""

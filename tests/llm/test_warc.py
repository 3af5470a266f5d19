"""WARC archives: round trips, segments over archives, broken archives, other writers' records."""

import gzip
import hashlib
import random

import duckdb
import pandas as pd
import pytest

from recollect.llm import warc

PAGES = "page_id long, url string, html string, digest string, n long, tag string"


def fixture():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abc <>é日\r\n0") for _ in range(n))
    long, short = text(3000), text(200)
    rows = [(i, f"http://h/{i}", text(rng.choice([0, 1, 50, 999, 1000, 5000, 40_000])), "d", i, "t") for i in range(120)]
    rows += [(200 + i, "u", long, "d", 0, "t") for i in range(40)] + [(300 + i, "u", short, "d", 0, "t") for i in range(5)]
    rows += [(7, "again", long, None, None, None), (None, None, long, None, None, None), (None, " odd\r\nurl ", None, None, None, None), (400, "", "", None, None, None), (401, "=?utf-8?B?x?=", None, None, None, None)]
    rows += [(500, "u", "y" * 1000, None, None, None), (501, "u", "y" * 1000, None, None, None), (502, "u", "z" * 999, None, None, None), (503, "u", "z" * 999, None, None, None)]
    return [*rows, (600, "long", "x" * 3_000_000, None, None, None)]


def want_of(rows):
    heads = {}
    for page, _, html, *_ in rows:
        if len((html or "").encode()) >= 1000:
            heads[html] = max(heads.get(html, -1), -1 if page is None else page)
    out = []
    for page, url, html, *_ in rows:
        raw = (html or "").encode()
        head = heads.get(html)
        again = head is not None and page != head and not (page is None and head == -1)
        out.append((page, url, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", head if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_round_trip(spark, most, monkeypatch):
    monkeypatch.setattr(warc.beside_groups, "__kwdefaults__", {"most": most})
    rows = fixture()
    got = warc.round_trip(spark, spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert not any(r["problem"] for r in got)
    assert sorted(str((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == want_of(rows)


def test_rows_that_are_equal_have_one_response(spark):
    rows = [(5, "a", "q" * 2000, "", 0, ""), (5, "a", "q" * 2000, "", 0, ""), (5, "b", "q" * 2000, "", 0, "")]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(5, "response", None), (5, "revisit", 5), (5, "revisit", 5)]


def test_sql_says_the_same(spark, tmp_path):
    rows = [r for r in fixture() if r[0] not in (None, 7)]
    frame = pd.DataFrame([r[:3] for r in rows], columns=["page_id", "url", "html"])
    frame.to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    found = con.sql(warc.oracle())
    got = warc.round_trip(spark, spark.read.parquet(f"{tmp_path}/pages.parquet")).select(*found.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)


def test_segments_over_archives_and_payloads(spark, tmp_path):
    rows = fixture()
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(spark, spark.createDataFrame(rows, PAGES).repartition(2), folder, segment_bytes=700, archive_bytes=9_000)
    assert manifest.count() > 20
    got = [r for r in warc.read(spark, manifest, payloads=True).collect() if r["record_type"] == "response"]
    assert not any(r["problem"] for r in got) and {r["page_id"]: bytes(r["payload"]) for r in got if r["page_id"] not in (7, None)}[600] == b"x" * 3_000_000
    for r in got:
        assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]


def put(path, *records):
    with open(path, "wb") as f:
        for fields, block in records:
            head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
            f.write(gzip.compress(f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))


def test_broken_and_foreign_records(spark, tmp_path):
    block = warc.HTTP + b"transfer-encoding: Chunked\r\n\r\n" + b"5;ext=1\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: x\r\n\r\n"
    plain = b"HTTP/1.0 200 OK\r\nContent-Length: 11\r\n\r\nhello world"
    digest = warc.base32(hashlib.sha1(b"hello world").digest())

    def parts(name, cuts, total=None, skip=(), first=None):
        out, at = [], [0, *cuts, len(block)]
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True), 1):
            about = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Payload-Digest": first or digest} if k == 1 else {"WARC-Type": "continuation", "WARC-Segment-Origin-ID": name, "WARC-Record-ID": f"{name}{k}"}
            about |= {"WARC-Segment-Number": k} | ({"WARC-Segment-Total-Length": len(block) if total is None else total} if k == len(at) - 1 else {})
            if k not in skip:
                out.append((about, block[a:b]))
        return out

    whole, short, gap, headless, endless, lying = parts("<a>", [9, 100, 101, 110]), parts("<b>", [50], total=9), parts("<c>", [30, 60, 90], skip=(3,)), parts("<d>", [60], skip=(1,)), parts("<e>", [60, 90], skip=(3,)), parts("<f>", [70], first=warc.base32(b"0" * 20))
    rest = [({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"software: x"), ({"WARC-Type": "response", "WARC-Record-ID": "<g>", "WARC-Payload-Digest": "sha1:" + hashlib.sha1(b"hello world").hexdigest(), "WARC-Target-URI": "http://a\r\n  b"}, plain)]
    rest += [({"WARC-Type": "response", "WARC-Record-ID": "<h>"}, block[:-3]), ({"WARC-Type": "response", "WARC-Record-ID": "<j>", "WARC-Block-Digest": warc.base32(b"1" * 20)}, block), ({"WARC-Type": "revisit", "WARC-Record-ID": "<k>", "WARC-Refers-To": "<zz>", "WARC-Payload-Digest": digest}, b""), ({"WARC-Type": "revisit", "WARC-Record-ID": "<l>", "WARC-Refers-To": "<a>", "WARC-Payload-Digest": digest}, b"")]
    twice = [*parts("<m>", [60]), parts("<m>", [60])[1]]
    everything = [*whole, *short, *gap, *headless, *endless, *lying, *rest, *twice]
    random.Random(2).shuffle(everything)
    put(tmp_path / "1.warc.gz", *everything[::2])
    put(tmp_path / "2.warc.gz", *everything[1::2])
    manifest = spark.createDataFrame([(f"file://{tmp_path}/{k}.warc.gz", 0, 1) for k in (1, 2)], warc.MANIFEST)
    got = {r["record_id"]: r for r in warc.read(spark, manifest, payloads=True).collect()}
    assert set(got) == {f"<{c}>" for c in "abcdefghjklm"}
    assert {k for k, r in got.items() if not r["problem"]} == {"<a>", "<g>", "<k>", "<l>"} and all(bytes(got[k]["payload"]) == b"hello world" for k in ("<a>", "<g>"))
    assert got["<g>"]["url"] == "http://a b" and "bytes, not 9" in got["<b>"]["problem"] and "missing" in got["<c>"]["problem"] and "missing" in got["<d>"]["problem"] and "last segment" in got["<e>"]["problem"] and "digest" in got["<f>"]["problem"]
    assert all(got[k]["payload_bytes"] is None and got[k]["payload"] is None for k in ("<b>", "<c>", "<d>", "<e>", "<f>", "<h>", "<j>", "<m>"))
    from recollect.llm import common

    seen = {r["url"]: r for r in warc.resolved(spark, common.staged(spark, warc.read(spark, manifest).withColumn("url", warc.F.col("record_id")), "found")).collect()}
    assert seen["<l>"]["payload_bytes"] == 11 and seen["<k>"]["problem"] and seen["<k>"]["payload_bytes"] is None


def test_message_in_pieces_of_any_size():
    payload = bytes(random.Random(1).randrange(256) for _ in range(9000))
    block = warc.HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(payload, 1000)
    for size in (1, 2, 3, 7, 999, 100_000):
        m = warc.Dechunked(True)
        for k in range(0, len(block), size):
            m.feed(block[k : k + size])
        m.end()
        assert b"".join(m.kept) == payload
    for bad in (block[:-1], block[:500], block.replace(b"3e8\r\n", b"3e7\r\n", 1), block + b"x\r\n"):
        with pytest.raises(ValueError):
            m = warc.Dechunked(False)
            m.feed(bad)
            m.end()


def test_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).collect() == []

import zlib
from array import array

from recollect.llm import sst, tokens
from recollect.llm.queries import tokenizer

DOCS = "doc_id long, text string, start long"


def test_round_trip_and_lookup(spark, tmp_path):
    path = tokenizer("byte_bpe_50k.json")
    rows = [(i * 7 - 50, f"text {i} with a few words\nand lines " * (i % 9), i) for i in range(400)] + [(5, None, 1), (5, "", 1), (None, "no id", 0), (3, "same", 0), (3, "same", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    manifest = sst.write(spark, docs, path, f"file://{tmp_path}/t", shard_bytes=8_000, block_bytes=1_000)
    assert manifest.count() >= 4
    library = tokens.Encoder(path).tokenizer
    ids = lambda t: array("I", library.encode(t or "", add_special_tokens=False).ids + [0]).tobytes()
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sst.read(spark, manifest).collect()))
    assert sorted((str(d), len(ids(t)) // 4, zlib.crc32(ids(t))) for d, t, _ in rows) == sorted((str(d), n, c) for _, d, n, c in got)
    at, before = 0, None
    for start, doc, n, _ in got:
        assert start == at and (before is None or doc >= before)
        at, before = at + n, doc
    found = sst.lookup(spark, manifest, [-50, 3, 5, 13, 9999, 2743])
    assert found == {-50: [ids(rows[0][1])], 3: [ids("same")] * 2, 5: [ids("")] * 2, 13: [ids(rows[9][1])], 2743: [ids(rows[399][1])]}


def test_empty(spark):
    assert sst.round_trip(spark, spark.createDataFrame([], DOCS), tokenizer("byte_bpe_50k.json")).collect() == []

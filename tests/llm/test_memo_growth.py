"""Token ids while the memo grows: batches that mix known and new pieces, and the whole queries, against the library."""

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from recollect.llm import tokens
from recollect.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("slots", [16, 1 << 16])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_all_batches_while_the_table_grows(name, slots, monkeypatch):
    path, rng = tokenizer(name), np.random.default_rng(3)
    monkeypatch.setattr(tokens.Encoder, "forget", lambda self: setattr(self, "memo", tokens.Memo(slots)))
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(3, 9, 90_000)]
    texts = [" ".join(words[int(i)] for i in (len(words) * rng.random(60) ** 1.2)) for _ in range(4_000)]
    library, encoder, sizes = Tokenizer.from_file(path), tokens.Encoder(path), set()
    for at in range(0, len(texts), 150):
        part = texts[at : at + 150]
        got = encoder.ids(pa.array(part, pa.string()))
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        sizes.add(encoder.memo.bits)
    assert len(sizes) >= (2 if slots > 16 else 3)


def library_ids(name, end):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    made = Tokenizer.from_file(tokenizer(name)).encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    return {r["doc_id"]: array("I", [*e.ids, end]).tobytes() for r, e in zip(rows, made, strict=True)}


def test_op1_query_equals_the_library(spark):
    want = {}
    for doc, ids in library_ids("word_bpe_49k.json", 1).items():
        for k, at in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[at : at + 4 * 4096]
            want[doc, k] = (at // 4, len(part) // 4, zlib.crc32(part))
    rows = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0] + [n for _, n in items])[:-1].tolist() and sum(n for _, n in items) <= 4096


def test_op2_query_equals_the_library(spark):
    at, want = 0, []
    for doc, ids in sorted(library_ids("byte_bpe_50k.json", 0).items()):
        want.append((doc, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_sorted_table_shards"](spark, SF).collect()) == want

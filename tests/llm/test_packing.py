import random
import zlib
from array import array
from collections import defaultdict

import pytest

from recollect.llm import packing, tokens
from recollect.llm.queries import tokenizer

TEXTS = ["Hello  world", "it's ok\n\nthen\tgo ", None, "", "a b  c", " lead", "été naïve ÉTÉ", "x" * 300, "don't!!! stop... 12345 ́x", "line one\nline two", "a\x1cb  c", "日本語 テキスト", "ΟΔΟΣ Σ", "İstanbul K \ufb01", "e\u0301a  \u0301x", "\0zero \0", "a\nb\n", "<|endoftext|> x"]
DOCS = "doc_id long, text string, start string, length string"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_equals_library(name):
    enc = tokens.Encoder(tokenizer(name))
    texts = [t or "" for t in TEXTS] * 2 + ["some more words and words", "Words, and some!"]
    assert enc.ids(texts) == [array("I", enc.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_plan_places_everything_once():
    rng = random.Random(5)
    for capacity in (10, 100, 4096):
        counts = defaultdict(int)
        for _ in range(400):
            counts[rng.choice([capacity, rng.randint(1, capacity), rng.randint(1, max(1, capacity // 8))])] += rng.randint(1, 9)
        slots, bins = packing.plan(dict(counts), capacity)
        seen, fill = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in slots:
            seen[length] += range(rank, rank + n)
            for k in range(n):
                fill[first + k].append((offset, length))
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in counts.items()}
        for items in fill.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in items) <= 2
        least = -(-sum(k * v for k, v in counts.items()) // capacity)
        assert len(fill) == bins and bins <= 1.1 * least + 1


def test_best_fit(spark):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(TEXTS)] + [(3, "again", None, None), (None, "no id", None, None), (99, "word " * 9000, None, None)], DOCS)
    rows = packing.best_fit(spark, docs, tokenizer("word_bpe_49k.json")).collect()
    library = tokens.Encoder(tokenizer("word_bpe_49k.json")).tokenizer
    ids = library.encode("word " * 9000, add_special_tokens=False).ids + [1]
    long = sorted((r for r in rows if r["doc_id"] == 99), key=lambda r: r["piece"])
    assert [(r["start"], r["length"]) for r in long] == [(0, 4096), (4096, 4096), (8192, len(ids) - 8192)]
    assert [r["ids_crc32"] for r in long] == [zlib.crc32(array("I", ids[at : at + 4096]).tobytes()) for at in (0, 4096, 8192)]
    assert sum(r["doc_id"] == 3 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.best_fit(spark, docs.limit(0), tokenizer("word_bpe_49k.json")).collect() == []

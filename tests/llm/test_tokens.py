"""The memo of pieces against a fresh tokenizer of the library: odd white space, long words, marks, a memo that fills up."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from recollect.llm import tokens
from recollect.llm.queries import tokenizer

SPACES = [" ", " ", " ", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\r\n", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", "　", ""]
WORDS = ["one", "Two", "ÉTÉ", "é", "́x", "“q”", "–", "…", "日本語", "ß", "İ", "Ω", "ﬁ", "\0", "a\0b", "don't", "x" * 70, "yz" * 300, "3.14", "a,b;c", "`t`", "😀", "K", "ÅA", "can't've"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_the_library(name, monkeypatch):
    path, rng = tokenizer(name), random.Random(9)
    texts = ["", None, " ", "\n", "a", " a", "a ", "\na", "a\n", *WORDS]
    for _ in range(800):
        odd = rng.random() < 0.4
        parts = [rng.choice(WORDS) if rng.random() < 0.5 else "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 30))]
        texts.append("".join(p + (rng.choice(SPACES) if odd else " ") for p in parts).strip(" " if rng.random() < 0.8 else ""))
    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for limit in (10, 10_000_000):
        monkeypatch.setattr(tokens.Encoder, "limit", limit)
        encoder = tokens.Encoder(path)
        for size in (7, 300, len(texts)):
            got = [x for i in range(0, len(texts), size) for x in encoder.ids(pa.array(texts[i : i + size], pa.string()))]
            assert [np.frombuffer(b, "<u4").tolist() for b in got] == want


def test_memo_grows_and_keeps_apart_what_shares_a_hash():
    memo, rng = tokens.Memo(16), np.random.default_rng(1)
    h = np.repeat(rng.integers(1, 1 << 63, 3000).astype(np.uint64), 2)
    check = np.arange(len(h), dtype=np.uint64)
    counts = rng.integers(0, 5, len(h))
    for part in np.array_split(np.arange(len(h)), 7):
        memo.add(h[part], check[part], np.repeat(check[part], counts[part]).astype(np.uint32), counts[part])
    slot = memo.find(h, check)
    assert (slot >= 0).all() and len(set(slot.tolist())) == len(h) and (memo.find(h, check + np.uint64(10**6)) < 0).all()
    for i in range(len(h)):
        assert memo.pool[memo.begin[slot[i]] : memo.begin[slot[i]] + memo.length[slot[i]]].tolist() == [i] * counts[i]

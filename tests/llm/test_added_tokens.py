"""Ids against a fresh tokenizer of the library, with nothing set on it."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from recollect.llm import tokens
from recollect.llm.queries import tokenizer


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_the_library_on_added_tokens(name):
    path, rng = tokenizer(name), random.Random(5)
    words = ["one", "Two", "été", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "x<|endoftext|>y", "<", "a,b", "\n", "K"]
    texts = ["one <|endoftext|> two", "<|endoftext|>", "", "plain text"] + [rng.choice([" ", " ", ""]).join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = tokens.Encoder(path)
    for _ in range(2):  # the second time from the memo
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(texts)] == want

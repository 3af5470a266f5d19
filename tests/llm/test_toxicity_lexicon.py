import random

import numpy as np

from recollect.llm import toxicity as tox


def fixture(bad):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(300)]
    rows = [" ".join([rng.choice(vocab) for _ in range(10)] + [bad[i % len(bad)] if i < 2000 else vocab[0]]) + f" n{i}" for i in range(12000)]
    return rows, np.array([float(i < 2000) for i in range(12000)])


def test_every_significant_form_is_learned():
    bad = [f"{a}{b}{c}gx" for a in "bdfgh" for b in "aeiou" for c in "bdfgk"][:100]
    assert {f.rstrip("$") for f in tox.lexicon(*fixture(bad))} == set(bad)


def test_a_whole_word_leaves_longer_ones_to_learn():
    texts, y = fixture(["zorg", "zorgat", "zorgun"])
    calm = [f"a calm text on zorg{x} number {i}" for x in ("es", "ir") for i in range(900)]  # so that the stem won't do
    made = tox.lexicon(texts + calm, np.append(y, np.zeros(len(calm))))
    assert {"zorg$", "zorgat$", "zorgun$"} <= set(made)

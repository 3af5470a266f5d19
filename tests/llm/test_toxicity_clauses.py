"""Texts that hold the same words, toxic or not by their clauses: counting words can't tell them apart, the grammar can."""

import random

import numpy as np

from recollect.llm import toxicity as tox

INSULTS = ["idiot", "moron", "scum", "loser", "clown"]


def made(n, seed):
    rng = random.Random(seed)
    filler = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 12)))
    texts, labels = [], []
    for _ in range(n):
        x, y = rng.choice(INSULTS), rng.choice(["kill", "hurt", "stab"])
        toxic = rng.random() < 0.5
        if toxic:
            clause = rng.choice([f"you are such a {x}", f"they are {x} and worse", f"we will {y} you", f"{x} that you are"])
        else:
            clause = rng.choice([f"you are not a {x}", f"they were never {x} at all", f"she said you {x}", f'the sign reads "{x}" you', f"to {y} time", f"nobody will {y} you"])
        texts.append(f"{filler()}. {clause}. {filler()}.")
        labels.append(int(toxic))
    return texts, labels


def ranks(score, labels):
    good, bad = [s for s, y in zip(score, labels, strict=True) if not y], [s for s, y in zip(score, labels, strict=True) if y]
    return float(np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]))


def test_clauses_decide_where_words_cannot():
    train, test = made(800, 1), made(400, 2)
    grammar = tox.learn(*train)
    found = ranks(grammar.score(grammar.features(test[0], {})), test[1])
    count = ranks([sum(w in t for w in [*INSULTS, "kill", "hurt", "stab"]) for t in test[0]], test[1])
    assert found > 0.97 and count < 0.6
    without = tox.ablation(*test, grammar)
    assert without["aimed"] < without[""] - 0.02


def test_a_text_over_the_sample_is_passed_over(spark):
    rows = [(i, "x" * 5_000 if i % 10 == 0 else f"{'zorgat' if i % 3 == 0 else 'fine'} words {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxy'[i // 100]}") for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    grammar = tox.fit(docs, labels, most_bytes=20_000)
    assert any(f.startswith("zorg") for f in [*grammar.words, *grammar.stems])

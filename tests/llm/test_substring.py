import hashlib
import random
import re

import numpy as np

from recollect.llm import substring

DOCS = "doc_id long, text string, start long, window string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, k=13):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            w = WORD.findall(text or "")
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - k + 1):
            if doc is not None and first[tuple(w[i : i + k])] < doc:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(doc), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(60)] + ["É,", "x\xa0y", "—"]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 20, 70]))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.2 and rows:
            w = WORD.findall(rng.choice(rows)[1] or "")
        rows.append((rng.choice([i * 5, -i]), rng.choice([" ", "\n", " \t"]).join(w), i, "x"))
    loop = "a b c " * 40
    rows += [(9001, loop, 0, ""), (9002, "z " + loop, 0, ""), (9003, "", 0, ""), (9004, None, 0, ""), (None, rows[0][1], 0, ""), (rows[5][0], rows[5][1], 0, "")]
    rows += [(10_000 + i, " ".join(passages[-1] * 3), 0, "") for i in range(200)]
    got = substring.dedup(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute(rows)


def test_texts_and_other_columns(spark):
    p = " ".join(f"p{i}" for i in range(15))
    rows = [(1, f"x {p}\ny", 9, "a"), (2, f"{p}  tail é", 9, "b"), (3, "keeps   its\tspace", 9, None), (4, None, None, "c"), (None, p, 9, "d")]
    got = substring.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _start string")).collect()
    want = [rows[0], (2, "tail é", 6, "b"), *rows[2:]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_anchors():
    grams = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    assert substring.window_anchors(grams, 9).tolist() == [min(grams[i : i + 9]) for i in range(42)]


def test_empty(spark):
    assert substring.dedup(spark, spark.createDataFrame([], DOCS)).collect() == []

import random

import numpy as np
import pyarrow as pa

from recollect.llm import quality

DOCS = "doc_id long, text string, score double, distinct string"


def fixture():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeiolmnrst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocab) for _ in range(rng.randint(8, 150))]
        kind = rng.choice(["good"] * 5 + ["menu", "loud", "loop"])
        text = {"good": " ".join(w).capitalize() + ".", "menu": " | ".join(w), "loud": "!! ".join(w).upper(), "loop": " ".join([w[0]] * 30 + [w[1]] * 30)}[kind]
        rows.append((i, text, 0.0, "x"))
        labels.append((i, int(kind == "good"), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows + [(5000, None, 0.0, ""), (5001, "", 0.0, ""), (None, rows[0][1], 0.0, ""), (4, rows[4][1], 0.0, "")], DOCS)
    got = quality.classify(spark, docs, spark.createDataFrame([*labels, (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + 4
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 250 and sum(truth[r["doc_id"]] == r["predicted"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[5000] == by[5001]


def test_column_equals_rules(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 1] > 0.5) & (x[:, 4] <= 0.3) | (x[:, 7] > 0.9)).astype(float)
    model = quality.fit(x, y)
    want = 1 / (1 + np.exp(-(model.intercept + sum(w * quality.applies(r, x) for r, w in zip(model.rules, model.weights, strict=True)))))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATS))
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    assert np.allclose(np.sort(got), np.sort(want)) and np.mean((want > 0.5) == y) > 0.9


def test_statistics():
    s = quality.text_stats(pa.record_batch({"doc_id": [1, 2, 3], "text": ["One two two.\nSIX | 7", None, "   "]}))
    got = dict(zip(quality.STATS, s[0], strict=True))
    assert np.isclose(got["log_words"], np.log(7)) and np.isclose(got["distinct"], 1) and got["repeats"] == 0
    assert got["bars_share"] == 1 / 20 and got["words_a_line"] == 3 and not s[1:].any()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(spark, spark.createDataFrame([], DOCS), none).collect() == []
    assert len(quality.classify(spark, spark.createDataFrame([(1, "a b", 0.0, "")], DOCS), none).collect()) == 1


def test_statistics_equal_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "É", "Z", "1", ".", "!", "|", "#", ",", " ", "\n", "\x0b", "the "]) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["x " * 200_000, "y" * 300_000]
    made = quality.text_stats(pa.record_batch({"doc_id": list(range(len(texts))), "text": texts}))
    for text, row in zip(texts, made, strict=True):
        raw = text.encode()
        w = [x for x in raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if x]
        share = [sum(raw.count(bytes([b])) for b in of) / max(1, len(raw)) for of in quality.CLASSES.values()]
        if not w:
            assert not row.any()
            continue
        counts = {x: w.count(x) for x in set(w)} if len(w) < 1000 else {w[0]: len(w)}
        lines, stops = raw.count(b"\n") + 1, sum(raw.count(bytes([b])) for b in quality.CLASSES["stops"]) + 1
        want = [np.log1p(len(w)), sum(map(len, w)) / len(w), len(counts) / len(w), sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w), max(counts.values()) / len(w), len(w) / lines, len(w) / stops, *share]
        assert np.allclose(row, want)

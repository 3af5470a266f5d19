import random
import re

from recollect.llm import decontam

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id long"


def words(text):
    return re.findall(r"[^\W_]+", re.sub("([\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", (text or "").lower()))


def cut(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    """An item of fewer than five words is one shingle, its whole sequence."""
    out = {}
    for doc, t, *_ in docs:
        for item, u, *_ in items:
            k = min(5, len(words(u)))
            a, b = cut(t, k) if k else set(), cut(u, k) if k else set()
            if b and len(a & b) >= 0.8 * len(b) - 1e-9:
                out[doc, item] = max(out.get((doc, item), 0), len(a & b) / len(b))
    return out


def fixture():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(50)] + ["été", "x9"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 6, 9, 20, 60]))), 0) for i in range(60)] + [(100, None, 0), (101, "", 0), (3, "another text with the same id here", 0), (200, "secret answer is", 0), (201, "日本語の試験問題", 0), (202, "!?", 0), (203, "Ωmega", 0)]
    docs = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 5, 40, 900]))]
        if rng.random() < 0.7:
            p = (rng.choice(items)[1] or "none").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = "edit"
            w[len(w) // 2 : len(w) // 2] = p
        docs.append((i, " ".join(x.upper() if rng.random() < 0.1 else x + rng.choice(["", "", ",", "."]) for x in w), "c"))
    return docs + [(900, None, None), (901, "", None), (None, items[5][1] + " " + items[9][1], None), (4, docs[7][1], None), (950, "so the SECRET, answer is 7", ""), (951, "secret the answer is", ""), (952, "これは日本語の試験問題です", ""), (953, "日本 試験", ""), (954, "ωMEGA", "")], items


def test_equals_brute_force(spark):
    docs, items = fixture()
    made = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert {(950, 200), (952, 201), (954, 203)} <= set(want) and not {d for d, _ in want} & {951, 953}
    for rows in (decontam.BROADCAST_ROWS, 0):  # broadcast and shuffle
        got = decontam.containment(spark, *made, broadcast_rows=rows).collect()
        assert {(r["doc_id"], r["item_id"]): r["containment"] for r in got} == want and len(got) == len(want)
    bad = {d for d, _ in want}
    kept = decontam.clean(spark, *made).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(d) for d, *_ in docs if d not in bad)


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontam.containment(spark, docs, items).collect() == []
    assert decontam.clean(spark, docs, items).collect() == []


def test_clashing_names_and_a_very_long_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta"
    rows = [(1, "x " * 400_000 + item, 5, "n"), (2, "alpha beta", 6, "n"), (3, None, 7, "n"), (None, f"{item} end", 8, "n"), (None, "other", 9, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaked int, _r0_id string")
    got = decontam.clean(spark, docs, spark.createDataFrame([(4, item, 0)], ITEMS))
    assert got.columns == docs.columns and sorted(r["leaked"] for r in got.collect()) == [6, 7]

"""Plans on small tables of their own, against brute force."""

import pandas as pd

from recollect.plans.queries import QUERIES


def run(spark, folder, name, **tables):
    for t, rows in tables.items():
        pd.DataFrame(rows).to_parquet(f"{folder}/{t}.parquet")
    return QUERIES[name](spark, str(folder)).collect()


def test_fragment_recall_searches_every_item_and_its_whole_text(spark, tmp_path):
    items = {i: " ".join(f"w{i}x{k}" for k in range(n)) for i, n in ((1, 5), (7, 30), (10, 60), (12, 8))}
    docs = [f"a {t} b" for t in items.values()] + [items[7][:70] + " other end", items[10][40:] + items[10][:40]]
    want = {i: sum(all(t[k : k + 40] in d for k in range(0, len(t), 40)) for d in docs) for i, t in items.items()}
    got = run(spark, tmp_path, "fragment_recall", benchmark={"item_id": list(items), "text": list(items.values())}, documents={"doc_id": list(range(len(docs))), "text": docs})
    assert {r["item_id"]: r["hits"] for r in got} == want and want[7] == 1 and want[10] == 2


def test_guardrails_takes_every_item_and_its_whole_text(spark, tmp_path):
    items = {3: "Never push to main", 41: "abcdefghijk", 150: "x" * 5 + "QUIET"}
    turns = ["we PUSH it", "never mind", "fghij", "quiet, please", "k", "push to ma"]
    want = {}
    for i, t in items.items():
        hits = sum(p in u.lower() for p in {t.lower()[k : k + 5] for k in range(0, len(t), 5)} for u in turns)
        want |= {i: hits} if hits else {}
    got = run(spark, tmp_path, "guardrails", benchmark={"item_id": list(items), "text": list(items.values())}, conversations={"conv_id": list(range(6)), "turn": [0] * 6, "role": ["user"] * 6, "text": turns})
    assert {r["item_id"]: r["hits"] for r in got} == want and want[150] == 1


def test_scope_graduation_takes_the_first_of_another_scope_over_the_bar(spark, tmp_path):
    near = [[1.0, 0.001 * i] for i in range(15)]  # more neighbours of the own scope than ten
    rows = [(i, 0, v) for i, v in enumerate(near)] + [(20, 1, [0.0, 3.0]), (21, 1, [2.0, 0.9]), (22, 2, [1.0, 0.0]), (23, 2, [-1.0, 0.2]), (24, 1, [0.0, 0.0])]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5 or 1)
    want = {}
    for i, scope, v in rows:
        first = next((j for j, other, w in rows if other != scope and cos(v, w) >= 0.85), None)
        want |= {} if first is None else {i: first}
    got = run(spark, tmp_path, "scope_graduation", embeddings={"vec_id": [r[0] for r in rows], "label": [r[1] for r in rows], "embedding": [r[2] for r in rows]})
    assert {r["query_id"]: r["other_id"] for r in got} == want and want[0] == 21 and 20 not in want and 23 not in want


def test_headings_and_checklists_over_all_lines(spark, tmp_path):
    text = "vor é\n# Eins \n- [x] done\n  ## Zwei#\n#no\n - [ ] open \n| a | b |\n# \n### Drei"
    docs = {"doc_id": [1, 2, 3], "text": [text, "plain é", None]}
    starts = [len(text[: text.index(x)].encode()) for x in ("# Eins", "  ## Zwei", "### Drei")] + [len(text.encode())]
    want = [(1, t, a, b) for t, a, b in zip(("Eins", "Zwei#", "Drei"), starts, starts[1:], strict=False)] + [(2, "Document Root", 0, 8)]
    assert sorted(map(tuple, run(spark, tmp_path, "headings", documents=docs))) == sorted(want)
    assert sorted(map(tuple, run(spark, tmp_path, "checklist_lines", documents=docs))) == [(1, "- [ ] open"), (1, "- [x] done")]

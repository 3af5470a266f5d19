import random
from collections import defaultdict

import corpus_pipeline
from test_jaccard import WORD, lower

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def near(rows, n, num, den):
    """Rows without those that reach a smaller doc_id by links."""
    sets = []
    for r in rows:
        w = WORD.findall(lower(r[1] or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = {r[0]: r[0] for r in rows}
    while True:
        before = dict(label)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and den * len(a & b) >= num * len(a | b):
                    x, y = rows[i][0], rows[j][0]
                    label[x] = label[y] = min(label[x], label[y])
        if label == before:
            return [r for r in rows if label[r[0]] == r[0]]


def repeats(rows, k=13):
    first, out = {}, []
    for r in rows:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - k + 1):
            first[tuple(w[i : i + k])] = min(first.get(tuple(w[i : i + k]), r[0]), r[0])
    for r in rows:
        w, gone = WORD.findall(r[1] or ""), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < r[0]:
                gone.update(range(i, i + k))
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
        out.append((r[0], text, *r[2:4], len(text) if gone else r[4]))
    return out


def fixture():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeiolmnrst") for _ in range(rng.randint(2, 7)))
    vocab = [word() for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(12, 40))) for i in range(8)]
    shared, base, texts = say(70), say(120), []
    for i in range(260):
        t = say(rng.randint(20, 150))
        kind = i % 10
        if kind == 1:
            t += ". Moron, you. " + say(5)  # a clause of its own
        elif kind == 2:
            t = say(8) + " " + shared + " " + t
        elif kind == 3:
            t += " " + rng.choice(items)[1]
        elif kind == 4:
            w = base.split()
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        texts.append(t)
    rows = [(i, t, rng.choice(["en", None]), f"s{i % 3}", len(t)) for i, t in enumerate([*texts, ""])] + [(500, None, "en", "s1", None)]
    return rows, items, [(i, 1, int(i % 10 == 1)) for i in range(260)]


def test_stages_and_run(spark, tmp_path):
    rows, items, labels = fixture()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = sorted(map(tuple, docs.collect()), key=lambda r: r[0])
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        got = sorted(map(tuple, after.collect()), key=lambda r: r[0])
        if name == "toxicity":
            assert [r[0] for r in got] == [r[0] for r in before if "Moron" not in (r[1] or "")]
        elif name == "near copies":
            assert got == near(before, 5, 80, 100) and len(got) < len(before) - 20
        elif name == "repeated passages":
            assert got == repeats(before) and got != before
        else:
            leaked = [r[0] for r in before if any(f" {t} " in f" {r[1]} " for _, t in items)]
            assert [r[0] for r in got] == [r[0] for r in before if r[0] not in leaked] and leaked
        after.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    want = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    fill = defaultdict(int)
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_clashing_names_an_empty_table_and_odd_rows(spark, tmp_path):
    rows, items, labels = fixture()
    rows = [*rows[:80], (None, "no id at all, but words enough to be a text of its own", "en", "s", 1), (3, rows[3][1], "en", "s9", 2), (700, "z" * 400_000, None, None, None), (701, "", "en", None, 0)]
    extra = ", gone int, leaked string, _spans int, _span_doc int, _r0_id int, _r0_spans string, part int, class int, start int"
    names = [c.split()[0] for c in (COLUMNS + extra).split(", ")]
    docs = spark.createDataFrame([(*r, 1, "l", 2, 3, 4, "s", 5, 6, 7) for r in rows], COLUMNS + extra)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names and {tuple(r)[5:] for r in out.collect()} == {(1, "l", 2, 3, 4, "s", 5, 6, 7)}
        kept = [r["doc_id"] for r in out.collect()]
        assert None in kept and 700 in kept and 701 in kept
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() >= len(rows)
    docs.limit(0).select(*names[:5]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

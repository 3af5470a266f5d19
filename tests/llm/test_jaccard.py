import random
import re

from recollect.llm import jaccard

DOCS = "doc_id long, text string, rep string, n long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """(doc_id, n_shingles, component_id, class_id); rows that share a doc_id are one node."""
    sets = []
    for doc, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        sets.append((doc, {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return sorted((d, len(s), find(d), min(e for e, t in sets if t == s) if s else d) for d, s in sets)


def fixture(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "naïve\xa0x"]
    rows = []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 9, 11, 12, 30, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w += [rng.choice(vocab)]
            rows.append(rng.choice([" ", "\n", "\t "]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w))
    rows += ["", None, "   \n", "One", "one", "one two", "ONE  two "]
    rng.shuffle(rows)
    return [(i * 3 + 1, t, "x", 7) for i, t in enumerate(rows)]


def test_equals_brute_force(spark):
    rows = fixture()
    got = jaccard.linked_components(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["class_id"]) for r in got) == brute(rows)


def test_all_links_of_classes(spark):
    rows = fixture(5)
    members, classes, links = jaccard.jaccard_join(spark, spark.createDataFrame(rows, DOCS))
    rep = {r["class"]: r["rep"] for r in classes.collect()}
    got = sorted(tuple(sorted((rep[r["a"]], rep[r["b"]]))) for r in links.collect())
    sets = {}
    for d, t, *_ in sorted(rows):
        w = WORD.findall(lower(t or ""))
        s = frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)])
        if w and s not in sets.values():
            sets[d] = s
    want = [(d, e) for d in sets for e in sets if d < e and 100 * len(sets[d] & sets[e]) >= 90 * len(sets[d] | sets[e])]
    assert got == sorted(want) and want
    assert sorted((r["doc_id"], r["n_shingles"]) for r in members.collect()) == sorted((d, n) for d, n, *_ in brute(rows))


def test_rows_that_share_an_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " tail"
    for rows in ([(1, a), (1, c), (2, near(c))], [(1, c), (1, a), (2, near(c))], [(4, a), (9, near(a)), (9, b), (11, near(b)), (9, ""), (11, "")], [(3, a), (5, a), (5, ""), (6, "")], [(7, a)] * 40 + [(8, near(a))] * 40 + [(2, near(a)), (2, None)]):
        full = [(d, t, "x", 1) for d, t in rows]
        got = jaccard.linked_components(spark, spark.createDataFrame(full, DOCS).repartition(3)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["class_id"]) for r in got) == brute(full)


def test_a_very_long_text_and_clashing_names(spark):
    words = [f"v{i * 7919 % 100003}" for i in range(150_000)]
    rows = [(5, " ".join(words)), (6, " ".join(words[:-3000])), (8, " ".join(words[:80_000])), (9, "x" * 3_000_000), (10, None)]
    docs = spark.createDataFrame([(d, t, 1, 2, "n") for d, t in rows], "doc_id long, text string, gone int, _r0_id int, class string")
    got = jaccard.one_of_each(spark, docs, 3, 90, 100)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [5, 8, 9, 10]


def test_parts_are_the_same_components(spark):
    for seed in (3, 4):
        rows = fixture(seed)
        got = {r["doc_id"]: r["part"] for r in jaccard.parts(spark, spark.createDataFrame(rows, DOCS), 3, 90, 100).collect()}
        assert got == {d: c for d, _, c, _ in brute(rows) if c != d}


def test_chain_hot_group_and_odd_rows(spark):
    words = [f"a{i}" for i in range(200)]
    chain = [" ".join(words[:k] + [f"b{i}" for i in range(k, 200)][::-1][:0] + words[k:]) + " x" * k for k in range(1)]
    rows = [(i, chain[0], "x", 0) for i in range(300)] + [(500 + k, " ".join(words[2 * k :] + [f"t{j}" for j in range(2 * k)]), "x", 0) for k in range(12)]
    rows += [(None, "no id here at all", "x", 0), (7, chain[0], "x", 0)]
    got = jaccard.linked_components(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 400} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 500} == {0}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.linked_components(spark, empty).collect() == [] and jaccard.one_of_each(spark, empty).collect() == []

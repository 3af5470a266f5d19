"""Graph, vector and window operators against loops over small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import folds, graphs, lines, ranks, vectors, walks


def test_traversal(spark):
    edges = [("a", "b", 0.9, "r"), ("b", "c", 0.9, "r"), ("a", "c", 0.5, "r"), ("c", "a", 1.0, "r"), ("c", "d", 0.5, "s"), ("d", "e", 1.0, "r"), ("e", "f", 1.0, None)]
    df = spark.createDataFrame([(*e, None, None) for e in edges], "src string, dst string, confidence double, relation string, valid_from int, valid_to int")
    start = spark.createDataFrame([("a",)], "id string")
    got = {r["node"]: (round(r["confidence"], 4), r["hops"]) for r in graphs.traversed(df, start).collect()}
    assert got == {"b": (0.9, 1), "c": (0.81, 2), "d": (0.405, 3), "e": (0.25, 3)}  # a is never reached better than it began; e comes behind the first, weaker visit of d
    assert {r["node"] for r in graphs.traversed(df, start, relation="r").collect()} == {"b", "c"}
    late = df.withColumn("valid_from", F.when(F.col("dst") == "c", 5))
    assert {r["node"] for r in graphs.traversed(late, start, as_of=F.lit(4)).collect()} == {"b"}
    star = spark.createDataFrame([("a", f"n{i:03}", 1.0) for i in range(80)], "src string, dst string, confidence double")
    assert graphs.traversed(star, start, each=50).count() == 50 and graphs.traversed(star, start, most=7).count() == 7


def test_activation_and_anchors(spark):
    edges = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.9), (11, 1, None), (3, 12, 1.0)], "src long, dst long, confidence double")
    got = {r["id"]: round(r["activation"], 4) for r in graphs.activated(edges, spark.createDataFrame([(1,), (2,)], "id long"), 0.7).collect()}
    assert got == {10: 0.63, 11: 0.7}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    near = spark.createDataFrame([("n1", 0.9), ("e1", 0.8), ("n2", 1.5), ("n3", 0.2)], "id string, similarity double")
    found = graphs.anchors([ids("e2", "e1"), ids("w1", "e1")], near).collect()
    assert sorted((r["id"], round(r["weight"], 3)) for r in found) == [("e1", 1.0), ("e2", 1.0), ("n1", 0.1), ("n2", 0.0), ("w1", 1.0)]


def test_expansion(spark):
    followed = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "b")], "src string, dst string")
    nodes = spark.createDataFrame([("a", "u", "g1"), ("b", "u", "general"), ("c", "u", "other"), ("d", "u", None), ("x", None, "general")], "id string, prefix string, scope string")
    of = lambda cue, depth, at: {r["id"]: r["score"] for r in graphs.expanded(spark.createDataFrame(at, "id string, score double"), followed, nodes, cue, depth, ["g1"]).collect()}
    assert of("succeeding", 3.0, [("a", 1.0)]) == {"b": 0.5, "d": 0.125} and of("succeeding", 1.0, [("a", 1.0)]) == {"b": 0.5}
    assert of("preceding", 2.0, [("c", 1.0)]) == {"b": 0.5, "a": 0.25} and of("relative", 1.0, [("a", 1.0)]) == {} and of("succeeding", 1.0, [("x", 1.0)]) == {}


def test_clusters_and_components(spark):
    rng = random.Random(4)
    nodes = list(range(40))
    pairs = sorted({(a, b) for a in nodes for b in nodes if a < b and rng.random() < 0.06})
    seeds, want = [], {}
    for i in nodes:
        own = next((s for s in seeds if (s, i) in pairs), None)
        want[i] = i if own is None else own
        seeds += [i] if own is None else []
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    edges, every = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(i,) for i in nodes], "id long")
    assert {r["id"]: r["cluster"] for r in graphs.greedy_clusters(edges, every).collect()} == {i: c for i, c in want.items() if sizes[c] > 1}
    label = {i: i for i in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["component"] for r in graphs.components(edges, every).collect()} == label
    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {r["component"] for r in graphs.components(path, spark.createDataFrame([(i,) for i in range(31)], "id long")).collect()} == {0}


def test_ancestors(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, None)], "node long, parent long")
    assert sorted(map(tuple, graphs.ancestors(rows).collect())) == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 1)]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(300, 5)), 1)
    v[7] = v[9]  # ties
    rows = spark.createDataFrame([(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)], "id long, embedding array<double>, scope string").repartition(5)
    rows = rows.unionByName(spark.createDataFrame([(500, None, "a"), (501, [1.0, 2.0], "a")], rows.schema))
    queries = rows.where("id % 50 = 0")
    plain = lambda df: df.drop("scope")
    for blocks in (1, 128):
        got = {(r["query_id"], r["rank"]): (r["id"], round(r["sim"], 6)) for r in vectors.top_k(plain(rows), plain(queries), 4, blocks).collect() if r["query_id"] < 300}
        for q in range(0, 300, 50):
            s = np.round(v @ v[q], 9)
            best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:4]
            assert [got[q, k + 1][0] for k in range(4)] == best
    pairs = {(r["query_id"], r["id"]) for r in vectors.within(rows, queries, 2.0).collect()}
    assert pairs == {(q, i) for q in range(0, 300, 50) for i in range(300) if i != q and (i - q) % 2 == 0 and round(float(v[i] @ v[q]), 9) >= 2.0}


def test_walks(spark):
    rng = random.Random(6)
    rows = [(k, i, rng.choice([-5, 2, 40])) for k in "ab" for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(6)
    want, smooth = {}, {}
    for k in "ab":
        x, y = 50, 5.0
        for _, _, v in [r for r in rows if r[0] == k]:
            x, y = min(100, max(0, x + v)), 0.3 * v + 0.7 * y
        want[k], smooth[k] = x, y
    piece = F.floor(F.col("i") / 7)
    assert {r["k"]: r["value"] for r in walks.clamped(df, "k", ["i"], piece, "v", 0, 100, 50).collect()} == want
    assert {r["k"]: r["value"] for r in walks.smoothed(df, "k", ["i"], piece, "v", 0.3, 5.0).collect()} == pytest.approx(smooth)


def test_ranks(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "x int, y int").repartition(7)
    assert [r["k"] for r in ranks.numbered(df, "x", "y").orderBy("x", "y").collect()] == list(range(1, 1001))
    assert ranks.numbered(df.limit(0), "x").collect() == []


def test_contained_pieces(spark):
    rules = spark.createDataFrame([(1, "abc"), (2, "b"), (3, "zz"), (4, "aa")], "item int, pattern string")
    turns = spark.createDataFrame([("xabcx",), ("aaaa",), (None,), ("b",)], "text string")
    assert {r["item"]: r["hits"] for r in folds.contained(rules, turns, "pattern", "text", 3).collect()} == {1: 1, 2: 2, 4: 1}
    items = spark.createDataFrame([(1, ["one two th", "ree four"]), (2, ["nowords"]), (3, ["a b"]), (4, ["x absent y"])], "item int, parts array<string>")
    docs = spark.createDataFrame([("zero one two three four",), ("ree four one two th",), ("many nowordsX a b",), ("a b",)], "text string")
    assert {r["item"]: r["hits"] for r in folds.all_parts(items, "item", "parts", docs, "text").collect()} == {1: 2, 2: 1, 3: 2, 4: 0}


def test_code(spark):
    rs = "//! Head\nfn a() {}\n/// One\n// aside\npub unsafe fn b() {}\nimpl X {\n}\nstruct C;"
    files = spark.createDataFrame([(1, "x/a.rs", rs), (2, "b.tsx", "export class K {\n}\nconst f = 1"), (3, "c.txt", "fn no() {}")], "id int, path string, content string")
    got = sorted((r["id"], r["start_line"], r["end_line"], r["kind"], r["name"], r["doc"]) for r in lines.symbols(files, "id", "path", "content").collect())
    assert got == [(1, 2, 8, "fn", "a", "Head"), (1, 5, 8, "fn", "b", "One"), (1, 8, 8, "struct", "C", None), (2, 1, 3, "class", "K", None), (2, 3, 3, "const", "f", None)]
    blocks = lines.blocks(files, "id", "path", "content")
    assert sorted((r["id"], r["block"]) for r in blocks.collect()) == [(1, "fn a() {}\n/// One\n// aside\npub unsafe fn b() {}"), (1, "impl X {\n}"), (1, "struct C;"), (2, "export class K {\n}\nconst f = 1")]
    paged = lines.paged(files, blocks, "id", "content")
    assert {r["id"]: r["content"] for r in paged.collect()} == {1: "//! Head\n[Paged Symbol: Reference 1-1]\n[Paged Symbol: Reference 1-2]\n[Paged Symbol: Reference 1-3]", 2: "[Paged Symbol: Reference 2-1]", 3: "fn no() {}"}
    assert {r["id"]: r["content"] for r in lines.restored(paged, blocks, "id", "content").collect()} == {1: rs, 2: "export class K {\n}\nconst f = 1", 3: "fn no() {}"}


def test_promotion():
    import pandas as pd

    many = pd.DataFrame([(i, "a" if i in (0, 90, 91) else None if i == 1 else f"s{i}") for i in range(100)], columns=["id", "session_id"])
    kept = folds.promoted(many, 75)
    assert len(kept) == 75 and {0, 90, 91} <= set(kept["id"]) and 74 not in set(kept["id"])
    assert folds.promoted(many.head(20), 75)["id"].tolist() == list(range(20))

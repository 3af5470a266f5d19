"""Every query with SQL against DuckDB; those without against brute force."""

import os
import re

import duckdb
import numpy as np
import pytest

from recollect.functions import stem, texts, words
from recollect.plans.dialect import TABLES
from recollect.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float) or hasattr(v, "normalize"):
        return round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    compare(spark, duck, name, DATA)


def compare(spark, duck, name, folder):
    df, found = QUERIES[name](spark, folder), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = [found.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, int | float) for x in a) else a == b


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DATA).collect()]


def table(duck, sql):
    return duck.sql(sql).fetchall()


def tokens(text):
    return [w for w in re.split(r"[^\w-]+|_+", (text or "").lower()) if w and w not in words.STOP_WORDS]


def test_every_query_is_tested():
    bare = {"stem_terms", "stemmed_postings", "compacted_results", "session_diffs", "diverse_results", "section_groups", "recursive_chunks", "pagerank_10", "token_packing", "search_packed", "search_keywords", "stemmed_topk", "weight_search", "tree_search"}
    assert set(QUERIES) - set(ORACLE_SQL) == bare


def test_stems(spark, duck):
    docs = table(duck, "SELECT doc_id, text FROM documents")
    want = {}
    for d, t in docs:
        for w in re.split(r"[^\w-]|_", (t or "").lower()):
            for x in [w] if w and w not in words.STOP_WORDS else []:
                want[d, stem.stem(x)] = want.get((d, stem.stem(x)), 0) + 1
    assert {(r["doc_id"], r["stem"]): r["n"] for r in rows(spark, "stemmed_postings")} == want
    stems = {r["term"]: r["stem"] for r in rows(spark, "stem_terms")}
    assert all(stem.stem(t) == s for t, s in stems.items()) and {s for _, s in want} == set(stems.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("name", ["rrf_fusion", "bm25_pool", "adaptive_fusion", "pooled_candidates", "fts_words"])
def test_pools_that_are_full(spark, name):
    """A pool of 200 isn't full on the smallest tables."""
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    compare(spark, connection, name, "/root/testdata/sf0.01")


def test_compaction(spark):
    for r in rows(spark, "compacted_results"):
        assert r["content"] is None or texts.token_estimate(r["content"]) <= 120
        if r["doc_id"] % 3 == 0 and r["content"]:
            assert r["content"].startswith("**Avoid**: ") and "**Why**" not in r["content"] or texts.CUT in r["content"] or len(r["content"]) < 400


def test_diffs(spark, duck):
    import difflib

    for r in rows(spark, "session_diffs"):
        users = [t or "" for (t,) in table(duck, f"SELECT text FROM conversations WHERE role = 'user' AND conv_id = {r['conv_id']} ORDER BY turn")]
        assert r["diff"] == "\n".join(difflib.unified_diff(users[0].split(), users[-1].split(), "a", "b", lineterm=""))


def test_diverse_results(spark, duck):
    e = {i: np.array(v, float) for i, v in table(duck, "SELECT vec_id, embedding FROM embeddings")}
    sims = {i: float(v @ e[0]) for i, v in e.items() if i}
    pool = sorted(sims, key=lambda i: (-round(sims[i], 9), i))[:20]
    chosen = []
    for _ in range(5):
        gain = {i: round(0.5 * sims[i] - 0.5 * max((float(e[i] @ e[j]) for j in chosen), default=0.0), 9) for i in pool if i not in chosen}
        chosen.append(max(gain, key=lambda i: (gain[i], -pool.index(i))))
    assert [r["vec_id"] for r in sorted(rows(spark, "diverse_results"), key=lambda r: r["place"])] == chosen


def test_chunks(spark, duck):
    docs = dict(table(duck, "SELECT doc_id, coalesce(text, '') FROM documents"))
    found = {}
    for r in rows(spark, "recursive_chunks"):
        found.setdefault(r["path"], {})[r["name"]] = r["chunk"]
    assert found.pop("docs/kept/1.md") == {"docs/kept/1.md#part-1": "kept"}
    for path, parts in found.items():
        text = docs[int(path.rpartition("/")[2].removesuffix(".md"))]
        assert all(len(p) <= 2000 and p != "old" for p in parts.values()) or not text
        ordered = [parts[f"{path}#part-{k}"] for k in range(1, len(parts) + 1)] if text else []
        assert "".join("".join(ordered).split()) == "".join(text.split())
    for r in rows(spark, "section_groups"):
        assert r["n_bytes"] <= 20_000


def test_pagerank(spark, duck):
    edges = table(duck, "SELECT l_partkey, l_suppkey + 10000000 FROM lineitem")
    edges += [(b, a) for a, b in edges]
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    a, b = (np.array([at[e[k]] for e in edges]) for k in (0, 1))
    out, r = np.bincount(a, minlength=len(nodes)), np.full(len(nodes), 1 / len(nodes))
    for _ in range(10):
        r = 0.15 / len(nodes) + 0.85 * np.bincount(b, r[a] / out[a], len(nodes))
    got = {x["node"]: x["rank"] for x in rows(spark, "pagerank_10")}
    assert got == pytest.approx({x: r[at[x]] for x in nodes}, abs=1e-12)


def test_packing_within_a_budget(spark, duck):
    docs = dict(table(duck, "SELECT doc_id, coalesce(text, '') FROM documents"))
    found = {}
    for r in rows(spark, "token_packing"):
        found.setdefault(r["source"], []).append(r)
    for (source,) in table(duck, "SELECT DISTINCT source FROM documents"):
        of = [d for (d,) in table(duck, f"SELECT doc_id FROM documents WHERE source = '{source}'")]
        pool = sorted(of, key=lambda d: (-(d * 37 % 1009), d))[:75]
        left, want = 8000, {}
        for d in sorted(pool, key=lambda d: ([1, 3, 4, 5][d % 4], -(d * 37 % 1009), d)):
            text = docs[d] if texts.token_estimate(docs[d]) <= left else texts.compacted(docs[d], left)
            if text is not None and texts.token_estimate(text) <= left:
                left -= texts.token_estimate(text)
                want[d] = text
        assert {r["id"]: r["text"] for r in found.get(source, [])} == want


def test_search_variants(spark):
    every, packed = rows(spark, "search_results"), rows(spark, "search_packed")
    assert sum(texts.token_estimate(f"{r['title']}\n{r['content']}") for r in packed) <= 6000 and packed
    order = {"wisdom": 1, "project": 3, "session": 4}
    ranks = [order[r["tier"]] for r in sorted(packed, key=lambda r: r["place"])]
    assert ranks == sorted(ranks) and {r["total"] for r in packed} == {every[0]["total"]}
    second = rows(spark, "search_keywords")
    assert all(r["place"] > 5 and r["tier"] == "session" for r in second)

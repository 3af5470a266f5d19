"""The divergence audit against brute force on Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recollect.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, least, top):
    df, n_lang, n, groups = Counter(), Counter(), Counter(), defaultdict(set)
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        w = terms(text)
        df.update((lang, t) for t in set(w))
        n_lang.update((lang, t) for t in w)
        n.update((lang, source, t) for t in w)
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), k in df.items() if x == lang and k >= least]
        v = len(kept)

        def share(count, total, v=v):
            return 1 + 10**9 * (count + 2) // (total + 2 * v)

        whole = sum(n_lang[lang, t] for t in kept)
        p = {s: {t: share(n[lang, s, t], sum(n[lang, s, u] for u in kept)) for t in kept} for s in sources}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(far(p[s][t], q), t) for t in kept if n[lang, s, t] and p[s][t] > (q := share(n_lang[lang, t], whole))]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top}
    return out


def fixture():
    rng = random.Random(4)
    vocab = ["ab", "AB", "Ab", "é", "É", "日本", "x_y", "l'eau", "z" * 70, "Z" * 70, "ßx", "\x85", "q1r"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(6)]
    docs = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", "S2", "é", None])
        docs.append((i, rng.choice([" ", "\n", ".", "7", "\0"]).join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 20, 60]))), lang, source, "t", "n"))
    docs += [docs[3], docs[3], (900, None, "en", "only null", None, None), (901, "", "fr", "a", None, None), (902, "rare", "fr", "b", None, None), (903, "alone", "it", "x", None, None), (None, "ab " * 90_000, "en", "s1", None, None)]
    return docs


@pytest.mark.parametrize("tile", [(3, 2), (2048, 128)])
def test_equals_brute_force(spark, tile):
    docs = fixture()
    for least in (10, 1):
        got = divergence.audit(spark, spark.createDataFrame(docs, DOCS).repartition(5), least, 3, *tile).collect()
        want = brute(docs, least, 3)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {(r["lang"], r["source"], r["part"]) for r in got} >= {("fr", "a", "pair"), ("en", "only null", "pair"), ("it", "x", "term")} - {("it", "x", "term")}


def test_a_full_task_is_emptied(spark, monkeypatch):
    tally = divergence.Tally()
    import pyarrow as pa

    for texts in (["a b a", "b"], ["B c", None]):
        tally.add(pa.record_batch({"lang": ["l", "l"], "source": ["s", "t"], "text": pa.array(texts, pa.string())}))
    rows = {tuple(r.values()) for r in tally.flush().to_pylist()}
    assert rows == {("l", "s", "a", 2, 1), ("l", "s", "b", 2, 2), ("l", "s", "c", 1, 1), ("l", "t", "b", 1, 1), ("l", "s", None, 0, 2), ("l", "t", None, 0, 2)}
    assert tally.flush() is None


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(500):
        total, v = rng.choice([0, 7, 10**9, 9 * 10**14]), rng.choice([1, 5, 10**6])
        n = rng.randint(0, total)
        assert divergence.shares(np.array([n]), np.array([total]), v).tolist() == [1 + 10**9 * (n + 2) // (total + 2 * v)]


def test_empty(spark):
    assert divergence.audit(spark, spark.createDataFrame([], DOCS)).collect() == []

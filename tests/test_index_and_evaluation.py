"""The stored index against a scan over what is left, with stems; and the sweep against its grid."""

import math
import random
import re
from collections import Counter

import pytest

from recollect.functions import stem, words
from recollect.operators import index
from recollect.plans import evaluation
from recollect.plans.registry import Tables

DATA = "/root/testdata/sf0.001"


def terms(text, stems):
    found = [w for w in re.split(r"[^\w-]+|_+", (text or "").lower()) if w and w not in words.STOP_WORDS]
    return [stem.stem(w) for w in found] if stems else found


def scanned(docs, questions, stems, k, scopes=None):
    docs = {i: d for i, d in docs.items() if scopes is None or d[0] in scopes}
    bags = {i: Counter(terms(text, stems)) for i, (_, text) in docs.items()}
    df = Counter(t for b in bags.values() for t in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = []
    for q, text in questions:
        scores = {}
        for i, b in bags.items():
            hits = [t for t in set(terms(text, stems)) if t in b]
            if hits:
                ratio = sum(b.values()) / mean
                scores[i] = sum(math.log((len(bags) - df[t] + 0.5) / (df[t] + 0.5) + 1) * b[t] * 2.2 / (b[t] + 1.2 * (0.4 + 0.6 * ratio)) for t in hits)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, i, round(s, 6), n + 1) for n, (i, s) in enumerate(best)]
    return sorted(out)


def same(got, want):
    assert [(q, i, k) for q, i, _, k in got] == [(q, i, k) for q, i, _, k in want] and [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in want], abs=2e-6)


@pytest.mark.parametrize("stems", [True, False])
def test_batches_leave_what_a_scan_finds(spark, tmp_path, stems):
    rng = random.Random(8)
    vocab = "running runs ran hotel hotels flying flies left-handed being was the happily happier Étude x9 nationally nation".split()
    text = lambda: rng.choice([None, "", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))])
    docs, held = {}, index.Index(spark, f"file://{tmp_path}/i", stems)
    questions = [(1, "Running to the hotels"), (2, "flies nation"), (3, "nothing known"), (4, None), (5, "étude left-handed x9 running")]
    asked = spark.createDataFrame(questions, "question long, text string")
    for batch in range(4):
        gone = rng.sample(sorted(docs), min(len(docs), 12)) if batch else []
        new = {i: (rng.choice(["a", "b", None]), text()) for i in [*range(100 * batch, 100 * batch + 40), *gone[:5]]}
        made = spark.createDataFrame([(i, s, t) for i, (s, t) in new.items()], "id long, scope string, text string")
        for _ in range(2 if batch == 2 else 1):  # a repeated batch does no harm
            held.change(batch, made, spark.createDataFrame([(i,) for i in [*gone, 99_999]], "id long"))
        docs = {i: d for i, d in docs.items() if i not in gone} | {i: (s or "general", t) for i, (s, t) in new.items()}
        for scopes in (None, ["a", "general"]):
            got = sorted((r["question"], r["id"], round(r["bm25"], 6), r["rank"]) for r in held.top(asked, 7, scopes).collect())
            same(got, scanned(docs, questions, stems, 7, scopes))
    df = Counter((t, s) for s, x in docs.values() for t in set(terms(x, stems)))
    assert {(r["term"], r["scope"]): r["df"] for r in held.frequencies().collect()} == df
    small = held.compacted(f"file://{tmp_path}/j")
    assert small.table("postings").count() < held.table("postings").count()
    assert sorted(map(tuple, small.top(asked, 7).collect())) == sorted(map(tuple, held.top(asked, 7).collect()))
    assert sorted(map(tuple, held.scored(asked, few=0).collect())) == sorted(map(tuple, held.scored(asked).collect()))


def test_a_lookup_reads_its_terms_alone(spark, tmp_path):
    held = index.Index(spark, f"file://{tmp_path}/i", False)
    held.change(0, spark.createDataFrame([(i, "s", f"common w{i}") for i in range(50)], "id long, scope string, text string"))
    plan = held.scored(spark.createDataFrame([(1, "w7")], "question long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w7)" in plan or "In(term, [w7])" in plan


@pytest.mark.parametrize("name", ["stemmed_topk"])
def test_stemmed_topk_over_the_tables(spark, name):
    import pyarrow.parquet as pq

    docs = {}
    for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist():
        i, s, t = r["doc_id"], r["source"], r["text"]
        if i % 11 == 0:
            docs[i] = (s, f"{s} {t or ''}")
        elif not (i % 5 > 0 and i % 7 == 0):
            docs[i] = (s, t)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    got = sorted((r["item_id"], r["doc_id"], round(r["bm25"], 6), r["rank"]) for r in getattr(evaluation, name)(Tables(spark, DATA)).collect())
    same(got, scanned(docs, items, True, 10))


def test_ternary_search_ends_beside_the_grid(spark):
    t = Tables(spark, DATA)
    asked, rows = evaluation.haystacks(t)
    tried = evaluation.narrowed(rows, asked, 0.0, 1.0, 3)
    grid = spark.createDataFrame([(b,) for b, _ in tried], "beta double")
    means = evaluation.evaluated(rows, asked, grid).groupBy("beta").agg(*(evaluation.F.avg(m).alias(m) for m in evaluation.ranking.MEASURES)).select("beta", evaluation.F.round(evaluation.ranking.objective(True), 9).alias("v"))
    assert {r["beta"]: r["v"] for r in means.collect()} == dict(tried)
    low, high = 0.0, 1.0
    for a, b in zip(tried[::2], tried[1::2], strict=True):
        assert (a[0], b[0]) == pytest.approx((low + (high - low) / 3, high - (high - low) / 3), abs=1e-8)
        low, high = (a[0], high) if a[1] < b[1] else (low, b[0])

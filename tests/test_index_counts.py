"""Documents are counted where they are and postings are dealt by document: no row a word behind the stemmer, none a question and document."""

from collections import Counter

import numpy as np
import pyarrow as pa

from recollect.functions import stem
from recollect.operators import index


def test_counts_of_rows_of_words():
    rows = [["running", "run", "runs", "naïve", "run"], None, [], ["left-handed", "runs"], ["x"] * 4]
    for stems in (False, True):
        dl, terms, tfs = index.counts_of(pa.array([["before"], *rows], pa.list_(pa.string())).slice(1), stems)
        assert dl.to_pylist() == [5, 0, 0, 2, 4]
        want = [Counter(stem.stem(w) if stems else w for w in r or []) for r in rows]
        assert [dict(zip(t, n, strict=True)) for t, n in zip(terms.to_pylist(), tfs.to_pylist(), strict=True)] == want
        assert [len(t) for t in terms.to_pylist()] == [len(w) for w in want]


def test_slices_leave_no_row_out():
    assert list(index.slices(np.array([2, 1, 9, 0, 0, 3, 3]), 3)) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert list(index.slices(np.array([], np.int64), 3)) == [] and list(index.slices(np.array([0, 0]), 3)) == [(0, 2)]


def test_counted_is_terms_of_by_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab"[i % 2], None if i % 7 == 0 else "running runs the run hotels " * (i % 5) + f"w{i}") for i in range(40)], "id long, scope string, text string")
    for stems in (False, True):
        held = index.Index(spark, f"file://{tmp_path}/{stems}", stems)
        want = Counter({(r["id"], r["scope"], r["term"]): r["tf"] for r in held.terms_of(docs, ["id", "scope"], "text").collect() if r["term"]})
        for most in (1, 30, 1 << 21):
            got = held.counted(docs, most).collect()
            assert sorted(r["id"] for r in got) == list(range(40)) and all(r["dl"] == sum(r["tfs"]) for r in got)
            assert Counter({(r["id"], r["scope"], t): n for r in got for t, n in zip(r["terms"], r["tfs"], strict=True)}) == want


def test_a_posting_is_dealt_once(spark, tmp_path):
    held = index.Index(spark, f"file://{tmp_path}/i", True)
    held.change(0, spark.createDataFrame([(i, "s", f"common word w{i}") for i in range(50)], "id long, scope string, text string"))
    plan = held.scored(spark.createDataFrame([(q, "common words w7") for q in range(9)], "question long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and "hashpartitioning(question#" not in plan.split("InMemoryTableScan")[0]


def test_rows_of_one_id_are_one_document(spark, tmp_path):
    held = index.Index(spark, f"file://{tmp_path}/i", True)
    held.change(0, spark.createDataFrame([(1, "s", "hotels"), (1, "s", "hotel runs"), (2, "s", "runs"), (2, "t", None)], "id long, scope string, text string"))
    assert {(r["term"], r["scope"]): r["df"] for r in held.frequencies().collect()} == {("hotel", "s"): 1, ("run", "s"): 2}
    assert sorted((r["id"], r["scope"], r["dl"], len(r["terms"])) for r in held.table("documents").collect()) == [(1, "s", 3, 2), (2, "s", 1, 1), (2, "t", 0, 0)]

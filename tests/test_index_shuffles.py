"""Terms of documents are counted where the document is, stems are not joined by term: an exchange by key, and one behind the stemmer."""

from recollect.operators import index, lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exchanges_by_key(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "running runs the run"), (2, "a", None), (3, "b", "the")], "id long, scope string, text string")
    for stems in (False, True):
        df = index.Index(spark, str(tmp_path), stems).terms_of(docs, ["id", "scope"], "text")
        assert plan(df).count("Exchange hashpartitioning") == 1 + stems and "Join" not in plan(df)
        got = sorted((tuple(r) for r in df.collect()), key=str)
        assert got == sorted([(1, "a", "run", 3)] * stems + [(1, "a", w, 1) for w in ("run", "runs", "running")] * (not stems) + [(2, "a", None, 0), (3, "b", None, 0)], key=str)
    df = lines.postings(docs, "id", "text")
    assert plan(df).count("Exchange hashpartitioning") == 2 and [tuple(r) for r in df.collect()] == [(1, "run", 3)]

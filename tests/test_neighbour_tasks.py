"""What a task of the neighbour search holds and sends, and the first partner of each query."""

import numpy as np
import pytest

from recollect.operators import vectors


def frame(spark, v, **more):
    return spark.createDataFrame([(i, x.tolist(), *(int(c[i]) for c in more.values())) for i, x in enumerate(v)], ", ".join(["id long", "embedding array<double>", *(f"{c} long" for c in more)]))


@pytest.mark.parametrize("spread", [0.05, 9.0])
def test_first_of_another_side(spark, spread):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6, 16))[rng.integers(0, 6, 500)] + rng.normal(0, spread, (500, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    side = rng.integers(0, 3, 500)
    sims = np.round(v @ v.T, 9)
    want = {i: int(np.flatnonzero(ok)[0]) for i in range(500) if (ok := (sims[i] >= 0.4) & (side != side[i])).any()}
    df = frame(spark, v, apart=side).repartition(5)
    got = vectors.within(df, df, 0.4, unit_rows=70, first=True).collect()
    assert {r["query_id"]: r["id"] for r in got} == want and len(got) == len(want) and all(r["sim"] == pytest.approx(sims[r["query_id"], r["id"]]) for r in got)


def test_queries_are_sent_a_few_times_where_cells_rule_out_nothing(spark, monkeypatch):
    v = np.random.default_rng(9).normal(size=(1500, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df, sent = frame(spark, v), []
    visits = vectors.visits

    def counted(queries, units, cells, least):
        out = visits(queries, units, cells, least)
        sent.append(out.count())
        return out

    monkeypatch.setattr(vectors, "visits", counted)
    vectors.within(df, df, 0.3).count()
    assert sent == [1500]  # it was nearly 128 times as many


def test_typed_rows_have_partners(spark):
    df = vectors.typed(frame(spark, np.eye(3)[[0, 0, 1]]))
    assert sorted((r["query_id"], r["id"]) for r in vectors.within(df, df, 0.5).collect()) == [(0, 1), (1, 0)]

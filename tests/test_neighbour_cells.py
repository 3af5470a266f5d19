"""Neighbours by cells against all products: the same rows, fewer products where vectors are clustered."""

import numpy as np
import pytest

from recollect.operators import vectors


def clustered(rng, n, spread):
    centres = rng.normal(size=(10, 24))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = centres[rng.integers(0, 10, n)] + rng.normal(0, spread, (n, 24))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("kind", ["clustered", "copies", "lengths", "odd"])
def test_same_rows_as_all_products(spark, kind):
    rng = np.random.default_rng(3)
    v = clustered(rng, 400, 0.05)
    if kind == "copies":
        v[::3] = v[0]
    if kind == "lengths":
        v = v * rng.uniform(0, 3, (len(v), 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    if kind == "odd":
        rows += [(900, None), (None, v[0].tolist()), (901, []), (902, v[1].tolist()[:5]), (903, v[1].tolist()[:5]), (0, v[2].tolist()), (904, [0.0] * 24)]
    df = spark.createDataFrame([(i, x, "ab"[(i or 0) % 2]) for i, x in rows], "id long, embedding array<double>, scope string").repartition(3)
    known = [(i, np.array(x)) for i, x in rows if i is not None and x is not None]
    for least, scoped in ((0.9, False), (0.2, True)):
        want = sorted((a, b) for a, x in known for b, y in known if a != b and len(x) == len(y) and round(float(x @ y), 9) >= least and (not scoped or (a - b) % 2 == 0))
        given = df if scoped else df.drop("scope")
        got = vectors.within(given, given, least, unit_rows=60).collect()
        assert sorted((r["query_id"], r["id"]) for r in got) == want


def test_share_of_products(spark):
    v = clustered(np.random.default_rng(5), 2000, 0.02)
    df = vectors.typed(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>"))
    cells = vectors.celled(df, 32)
    _, units = vectors.placed(df, cells, 200)
    asked = vectors.visits(df, units, cells, 0.95).groupBy("unit").count().join(units, "unit")
    products = asked.selectExpr("sum(count * n) AS p").first()["p"]
    assert products < 0.3 * len(v) ** 2


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert vectors.within(empty, empty, 0.5).collect() == []

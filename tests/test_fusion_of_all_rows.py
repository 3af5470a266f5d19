"""Reciprocal ranks over all rows that are found, not over pools."""

import pandas as pd

from recollect.plans.catalog import QUERY
from recollect.plans.queries import QUERIES


def test_every_found_row_has_a_score(spark, tmp_path):
    docs = {"doc_id": range(300), "text": [" ".join([QUERY[0], *["other"] * (i % 7)]) for i in range(300)]}
    vectors = {"vec_id": [0, *range(401, 490)], "label": [0] * 90, "embedding": [[1.0, i / 100 or 1.0] for i in range(90)]}
    pd.DataFrame(docs).to_parquet(f"{tmp_path}/documents.parquet")
    pd.DataFrame(vectors).to_parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r["score"] for r in QUERIES["rrf_fusion"](spark, str(tmp_path)).collect()}
    assert len(got) == 300 + 89
    assert got[489] == round(1 / 61 / (2 / 61), 6) and got[401] == round(1 / 149 / (2 / 61), 6)  # first and last of 89

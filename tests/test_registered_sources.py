"""Paths made of rounded values against the SQL, halves included."""

import duckdb
import pandas as pd

from recollect.plans.queries import ORACLE_SQL, QUERIES


def test_halves_round_as_in_the_sql(spark, tmp_path):
    values = [0.5, 1.5, 2.5, 74.5, 25.5, 3.49, 3.51]
    ts = pd.to_datetime(["2024-01-01"] * len(values)).astype("datetime64[us]")
    pd.DataFrame({"event_id": range(len(values)), "ts": ts, "user_id": range(len(values)), "event_type": "view", "value": values}).to_parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.sql(ORACLE_SQL["registered_sources"]).fetchall())
    assert sorted((r["user_id"], r["path"]) for r in QUERIES["registered_sources"](spark, str(tmp_path)).collect()) == want
    assert (0, "log/0.jsonl") in want and (3, "log/74.jsonl") in want

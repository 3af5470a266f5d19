"""Timers, times to live, late rows and tails: what happens without a further event, and over restarts."""

import datetime as dt
import time

import pytest

from recollect.sources import tails
from recollect.streaming import events, stateful

COLS = "event_id long, s long, user_id long, event_type string, value double"


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def put(rows, folder="in"):
        made = spark.createDataFrame(rows, COLS).selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value", "CAST(NULL AS STRING) AS props")
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")
        return events.stream(spark, f"{tmp_path}/{folder}")

    yield put
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_what_waits_fires_without_a_further_event(spark, tmp_path, feed):
    rows = [(i, i, i % 3, "a", 1.0) for i in range(23)]
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    stateful.run_until(stateful.triggers(feed(rows), 5, 1.0), out, state, lambda d: (d.agg({"n": "sum"}).first()[0] or 0) == 23)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = []
    for u in range(3):
        own = [i for i in range(23) if i % 3 == u]
        want += [(u, "threshold", 5, own[4])] + ([(u, "idle", len(own) - 5, own[-1])] if len(own) > 5 else [])
    assert got == sorted(want)
    more = feed([(100, 100, 1, "a", 1.0)])  # a later run goes on where the first ended
    stateful.run_until(stateful.triggers(more, 5, 1.0), out, state, lambda d: d.where("last = 100").count() == 1)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} - set(got) == {(1, "idle", 1, 100)}


def test_bursts_settle_and_values_expire(spark, tmp_path, feed):
    rows = [(i, 100 - i, i % 4, "abc"[i % 3], float(i)) for i in range(24)]
    out = f"{tmp_path}/out"
    stateful.run_until(stateful.settled(feed(rows), 1.0), out, f"{tmp_path}/state", lambda d: d.count() == 4)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(u, u, "abc"[u % 3], 6) for u in range(4)]
    kept, state = f"{tmp_path}/kept", f"{tmp_path}/kept-state"
    stateful.run_until(stateful.kept_values(feed(rows[:12], "kv"), 2.0), kept, state, lambda d: d.count() == 4)
    time.sleep(3)
    stateful.run_until(stateful.kept_values(feed([(50, 200, 1, "z", 5.0), (51, 201, 2, "a", 1.0)], "kv"), 2.0), kept, state, lambda d: d.count() == 6)
    got = {(r["user_id"], r["at"]): (r["live"], r["total"]) for r in spark.read.parquet(kept).collect()}
    assert got[1, 50] == (1, 5.0) and got[2, 51] == (1, 1.0) and got[1, 1] == (3, 15.0) and len(got) == 6


def test_late_rows_are_put_aside_once(spark, tmp_path, feed):
    def run(df):
        stateful.run_with_late_aside(df, lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/good/batch={n}"), f"{tmp_path}/late", f"{tmp_path}/clock", f"{tmp_path}/state", 60)

    run(feed([(1, 1000, 1, "a", 1.0), (2, 5000, 1, "a", 1.0), (3, 10, 1, "a", 1.0)]))
    run(feed([(4, 4939, 1, "a", 1.0), (5, 4940, 1, "a", 1.0), (6, 9000, 1, "a", 1.0)]))
    run(feed([(7, 4950, 1, "a", 1.0), (8, 9001, 1, "a", 1.0)]))
    late = {r["event_id"]: r["batch"] for r in stateful.late_rows(spark, f"{tmp_path}/late", events.EVENTS).collect()}
    assert late == {4: 1, 7: 2} and {r["event_id"] for r in spark.read.parquet(f"{tmp_path}/good").collect()} == {1, 2, 3, 5, 6, 8}


def test_windows_close_and_drop_what_is_late(spark, tmp_path, feed):
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    hour = 3600
    events.run(events.windowed(feed([(1, 10, 1, "a", 1.0), (2, hour + 5, 1, "a", 1.0), (3, 3 * hour, 1, "a", 1.0)])), out, state)
    events.run(events.windowed(feed([(4, 20, 1, "a", 1.0), (5, 3 * hour + 9, 1, "a", 1.0), (6, 6 * hour, 1, "a", 1.0)])), out, state)
    got = {int(r["window"]["start"].replace(tzinfo=dt.UTC).timestamp()) // hour: r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {0: 1, 1: 1, 3: 2}


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_tails_take_each_line_once(spark, tmp_path, piece):
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.log").write_bytes("eins\r\nzwei é\n\ndre".encode())
    (folder / "deep" / "b.log").write_text("one\n")
    (folder / "_skip").write_text("no\n")
    spark.dataSource.register(tails.Tail)

    def run(lines):
        df = spark.readStream.format("tail").option("folder", f"file://{folder}").option("piece_bytes", piece).load()
        stateful.run_until(df, f"{tmp_path}/out", f"{tmp_path}/state", lambda d: d.count() >= lines, most_seconds=40)
        return sorted((r["path"][-5:], r["line"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [("a.log", ""), ("a.log", "eins"), ("a.log", "zwei é"), ("b.log", "one")]
    assert run(4) == sorted(first)
    with open(folder / "a.log", "ab") as f:
        f.write(b"i\nvier\nhalf")
    (folder / "deep" / "b.log").write_text("x\n")  # shrank: read anew
    (folder / "c.log").write_text("new\n" + "long " * 100 + "\n")
    assert run(9) == sorted([*first, ("a.log", "drei"), ("a.log", "vier"), ("b.log", "x"), ("c.log", "new"), ("c.log", "long " * 100)])

import json

from recollect.sources import transcripts
from recollect.streaming import events


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", i % 2, "view", 1.0, None) for i, (h, m) in enumerate([(0, 1), (0, 2), (0, 50), (1, 10), (5, 0), (9, 0)])]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props")
    made.union(made.limit(1)).coalesce(1).write.parquet(f"{tmp_path}/in")
    for name, f in (("w", events.windowed), ("d", events.debounced), ("o", events.once)):
        events.run(f(events.stream(spark, f"{tmp_path}/in")), f"{tmp_path}/{name}", f"{tmp_path}/{name}-c")
    out = spark.read.parquet(f"{tmp_path}/w")
    assert {(r["window"]["start"].hour, r["n"]) for r in out.collect()} >= {(0, 4), (1, 1)}
    assert spark.read.parquet(f"{tmp_path}/o").count() == 6
    assert spark.read.parquet(f"{tmp_path}/d").count() >= 3
    assert {(r["user_id"], r["value"]) for r in events.latest_values(made).collect()} == {(0, 1.0), (1, 1.0)}


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role":"user","content":"hi"}\n{"speaker":"bot","text":"yo"}\nnot json\n{"message":"x"}\n')
    good, bad = transcripts.jsonl(spark, f"{tmp_path}/a.jsonl")
    assert sorted(map(tuple, good.collect())) == [("bot", "yo"), ("unknown", "x"), ("user", "hi")] and bad.count() == 1
    (tmp_path / "b.jsonl").write_text('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}\n{"role":"user","content":"c"}\n')
    assert sorted(r["text"] for r in transcripts.message_arrays(spark, f"{tmp_path}/b.jsonl").collect()) == ["a", "b", "c"]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"step_index": i, "type": t, "content": str(i), "created_at": f"2024-01-0{i}"}) for i, t in ((2, "PLANNER_RESPONSE"), (1, "USER_INPUT"), (3, "OTHER"))))
    doc = transcripts.step_log(spark, f"{tmp_path}/c.jsonl").collect()[0]
    assert doc["text"] == "## USER_INPUT\n1\n\n## PLANNER_RESPONSE\n2" and doc["created_at"] == "2024-01-01"
    (tmp_path / "d.json").write_text(json.dumps([{"question_id": "q", "question": "?", "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "t", "has_answer": True}]]}]))
    assert [tuple(r) for r in transcripts.questions(spark, f"{tmp_path}/d.json").collect()] == [("q", "?", "s1", 0, "user", "t", True)]
    assert transcripts.files(spark, str(tmp_path), "*.jsonl").count() == 3


def test_more_readers(spark, tmp_path):
    bad = transcripts.jsonl(spark, str((tmp_path / "q.jsonl").write_text('{"role":"u","text":"a"}\n{"role\n[1]\n') and tmp_path / "q.jsonl"))[1]
    transcripts.quarantined(bad, f"{tmp_path}/aside")
    assert sorted(r["line"] for r in spark.read.json(f"{tmp_path}/aside").collect())[-1] == '{"role'
    (tmp_path / "d").mkdir()
    for name, body in (("a", '[{"role":"user","content":"1"},{"content":"2"}]'), ("b", '{"messages":[{"role":"bot","content":"3"}]}'), ("c", '{"role":"x","content":"4"}\nnoise\n{"role":"y"}'), ("e", "")):
        (tmp_path / "d" / f"{name}.json").write_text(body)
    got = sorted((r["file"][-6], r["place"], r["role"], r["text"]) for r in transcripts.documents(spark, f"{tmp_path}/d/*.json").collect())
    assert got == [("a", 0, "user", "1"), ("a", 1, "unknown", "2"), ("b", 0, "bot", "3"), ("c", 0, "x", "4"), ("c", 1, "y", "")]
    (tmp_path / "k.toml").write_text('x = 1\ncontent = "b"\nrole="a"\nrole = "c"\nrole = "d"\ncontent = "e" # f\ncontent = "g"\n')
    assert [(r["role"], r["text"]) for r in transcripts.assigned(spark, f"{tmp_path}/k.toml").collect()] == [("a", "b"), ("d", "e")]
    (tmp_path / "w" / "target").mkdir(parents=True)
    (tmp_path / "w" / "deep" / "er").mkdir(parents=True)
    for name in ("a.md", "target/b.md", "deep/er/c.md"):
        (tmp_path / "w" / name).write_text(name)
    assert sorted(r["text"] for r in transcripts.files(spark, f"{tmp_path}/w", "*.md").collect()) == ["a.md", "deep/er/c.md"]
    assert [r["text"] for r in transcripts.files(spark, f"{tmp_path}/w", "*.md", depth=2).collect()] == ["a.md"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "log").write_text("one\ntwo\nhal")
    path = transcripts.tail(spark, f"{tmp_path}/t", spark.createDataFrame([], "path string, offset long")).first()
    assert (path["text"], path["next"]) == ("one\ntwo\n", 8)
    for offset, want in ((4, ("two\n", 8)), (8, ("", 8)), (99, ("one\ntwo\n", 8))):
        got = transcripts.tail(spark, f"{tmp_path}/t", spark.createDataFrame([(path["path"], offset)], "path string, offset long")).first()
        assert (got["text"], got["next"]) == want


def test_state_goes_on_over_batches(spark, tmp_path):
    made = spark.createDataFrame([(i, i * 10, 1, "ab"[i // 3 % 2], 1.0, None) for i in range(12)], "event_id long, s long, user_id long, event_type string, value double, props string").selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value", "props")
    for name, f, want in (("c", events.changes, {0, 3, 6, 9}), ("b", lambda e: events.batches(e, 5, "30 seconds"), {4, 9})):
        for part in (0, 1):  # two runs over files that arrive one after the other
            made.where(f"event_id DIV 6 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{name}")
            events.run(f(events.stream(spark, f"{tmp_path}/in-{name}")), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state")
        rows = spark.read.parquet(f"{tmp_path}/{name}").collect()
        assert {r["event_id"] if name == "c" else r["last"] for r in rows} == want


def test_markdown_files(spark, tmp_path):
    (tmp_path / "v" / "deep").mkdir(parents=True)
    for name, body in (("a.md", "---\ntitle: 'A b'\nscope: x\n---\n\n# Text\nmore"), ("deep/plain.md", "no head\n---\n"), ("skip.txt", "---\ntitle: no\n---\n")):
        (tmp_path / "v" / name).write_text(body)
    got = sorted((r["name"], r["title"], r["scope"], r["body"]) for r in transcripts.markdown(spark, f"{tmp_path}/v").collect())
    assert got == [("A b", "A b", "x", "# Text\nmore"), ("plain", None, None, "no head\n---\n")]

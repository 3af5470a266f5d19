"""Work that grows no faster than its input."""

import glob
import os
import time

from recollect.functions import texts
from recollect.operators import folds
from recollect.plans import basics, evaluation, feeds
from recollect.plans.registry import Tables
from recollect.sources import sinks, transcripts
from recollect.streaming import events, stateful


def test_patterns_are_found_in_one_pass(spark, monkeypatch, capsys):
    rules = spark.createDataFrame([(1, "abcde"), (2, "bcdef"), (3, "e\U0001f600"), (4, "a"), (5, "missing"), (6, None), (7, "abcde"), (8, "")], "item int, pattern string")
    turns = spark.createDataFrame([("xabcdefabcde",), ("e\U0001f600a",), (None,), ("",), ("abcd",), ("bcdefg\n" * 40_000,)], "text string")
    found = folds.contained(rules, turns, "pattern", "text", 5)
    got = {r["item"]: r["hits"] for r in found.collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 3, 7: 1, 8: 5}
    found.explain()
    assert "Generate" not in capsys.readouterr().out  # no row a piece
    monkeypatch.setattr(folds, "MOST_IN_TRIE", 0)
    short = turns.where("length(text) < 100")
    assert {r["item"]: r["hits"] for r in folds.contained(rules, short, "pattern", "text", 5).collect()} == {1: 1, 2: 1, 3: 1, 4: 3, 7: 1, 8: 4}
    monkeypatch.setattr(folds, "MOST_IN_TRIE", 1 << 22)
    monkeypatch.setattr(folds, "BLOCK", 7)
    assert {r["item"]: r["hits"] for r in folds.contained(rules, short, "pattern", "text", 5).collect()} == {1: 1, 2: 1, 3: 1, 4: 3, 7: 1, 8: 4}


def test_compaction_reads_what_the_budget_holds():
    for text in ("word. " * 1_000_000, "a\n\n" * 1_000_000, "x" * 6_000_000, "FooBar" * 1_000_000):
        start = time.process_time()
        short = texts.compacted(text, 120)
        assert time.process_time() - start < 1.5  # by counting whole texts, minutes
        assert short.endswith(texts.CUT) and texts.token_estimate(short) <= 120
        kept = len(short) - len(texts.CUT)
        assert texts.token_estimate(text[: kept + 4] + texts.CUT) > 120 or short.endswith("\n\n" + texts.CUT)


def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/many"
    rows = spark.range(300).selectExpr("id AS k", "IF(id = 7, NULL, concat('{\"role\": \"r', id, '\"}\\n')) AS value")
    sinks.write_files(rows.select(feeds.named("k").alias("path"), "value"), folder)
    found = glob.glob(f"{tmp_path}/many/*/*")
    assert len(found) == 300 and len(os.listdir(f"{tmp_path}/many")) <= 256 and not glob.glob(f"{tmp_path}/many/*/.*")
    assert {os.path.basename(x): open(x).read() for x in found}["k=8.txt"] == '{"role": "r8"}\n'
    assert transcripts.documents(spark, folder).count() == 299
    roots = []
    monkeypatch.setattr(transcripts, "step_log", lambda s, path, f=transcripts.step_log: roots.append(path) or f(s, path))
    monkeypatch.setattr(transcripts, "documents", lambda s, path, f=transcripts.documents: roots.append(path) or f(s, path))
    t = Tables(spark, "/root/testdata/sf0.001")
    assert feeds.step_logs(t).count() > 0 and feeds.message_documents(t).count() > 0
    assert len(roots) == 2 and not any("*" in x for x in roots)  # no root a file
    for x in roots:
        assert len(os.listdir(x.removeprefix("file://"))) <= 256


def test_arriving_files_and_keyed_rows(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(feeds, "ROWS_A_TASK", 100)
    t = Tables(spark, "/root/testdata/sf0.001")
    stream = feeds.arriving(t, "many")
    many = spark.read.parquet(feeds.arriving.__globals__["staging"].shared_dir(spark) + "/recollect-many-*")
    assert many.count() == t("events").count() and len(many.inputFiles()) > 5  # not one task's file
    stateful.settled(stream, 1.0).explain()
    plan = capsys.readouterr().out
    assert "InPandas" not in plan and "TransformWithState" in plan and "props" not in plan.split("TransformWithState")[-1].split("StreamingRelation")[0]  # rows of four columns, no frame a key


def test_bursts_are_dealt_to_more_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(feeds, "ROWS_A_TASK", 100)
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(events, "run_batches", lambda df, write, state, mode="append", tasks=None, f=events.run_batches: seen.append(tasks) or f(df, write, state, mode, tasks))
    t = Tables(spark, "/root/testdata/sf0.001")
    got = feeds.stream_bursts(t)
    assert got.agg({"n": "sum"}).first()[0] == t("events").count()
    assert seen == [-(-t("events").count() // 100)] and seen[0] > 4 and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_pairs_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(basics, "LINES_A_TASK", 500)
    t = Tables(spark, "/root/testdata/sf0.001")
    tasks = -(-t("lineitem").count() // 500)
    assert tasks > 4 and basics.entity_cooccurrence(t).rdd.getNumPartitions() == tasks


def test_grid_is_crossed_behind_the_shuffle(spark, capsys):
    rows = spark.createDataFrame([("1", (1, 0), "s1", True, True, 2.0, 0.5), ("1", (1, 1), "s1", False, True, None, 0.9)], "question string, id struct<conv: long, turn: int>, session string, gold boolean, gold_session boolean, bm25 double, dot double")
    asked = spark.createDataFrame([("1", ["s1"])], "question string, answer_session_ids array<string>")
    betas = spark.createDataFrame([(0.0,), (1.0,)], "beta double")
    found = evaluation.evaluated(rows, asked, betas)
    assert {r["beta"]: r["reciprocal"] for r in found.collect()} == {0.0: 0.5, 1.0: 1.0}
    found.explain()
    cut = next(x for x in capsys.readouterr().out.split("== Physical Plan ==")[-1].split("row_number()")[1:] if "keyword" in x)
    assert cut.index("BroadcastNestedLoopJoin") < cut.index("hashpartitioning(question")  # from the top: the grid stands above the rows' shuffle

"""Batches of saves against a loop over dictionaries; a failing batch leaves what was there."""

import datetime as dt
import hashlib
import os
import random

import pytest

from recollect.operators import saves

ROW = "id string, path string, title string, content string, scope string, session_id string, task_id string, created_at timestamp, entities array<string>"


class Plain:
    def __init__(self):
        self.episodes, self.metrics, self.mentions, self.followed, self.history, self.batch = {}, {}, {}, set(), [], 0

    def save(self, rows):
        self.batch += 1
        have = dict(self.episodes)
        by_path = {e["path"]: i for i, e in sorted(have.items()) if e["path"]}
        hashes = {}
        for i, e in sorted(have.items(), reverse=True):
            hashes[e["hash"]] = i
        last = {}
        for r in sorted(rows, key=lambda r: r["id"], reverse=True):
            if r["path"] and (r["path"] not in last or r["created_at"] >= last[r["path"]]["created_at"]):
                last[r["path"]] = r
        one = [*last.values(), *(r for r in rows if not r["path"])]
        sha = lambda r: hashlib.sha256(r["content"].encode()).hexdigest()
        fresh = {}
        for r in one:
            if not by_path.get(r["path"]) and sha(r) not in hashes:
                fresh[sha(r)] = min(fresh.get(sha(r), r["id"]), r["id"])
        new = []
        for r in one:
            known = by_path.get(r["path"]) if r["path"] else None
            if not known and fresh.get(sha(r)) != r["id"]:
                continue
            i = known or r["id"]
            if known:
                self.history.append((i, have[i]["title"], self.batch))
            else:
                self.metrics[i] = 50.0
                new.append(r)
            self.episodes[i] = {"path": r["path"], "title": r["title"], "hash": sha(r), "key": (r["session_id"].split("_")[0] if r["session_id"] else None, r["task_id"]), "at": r["created_at"]}
            self.mentions[i] = {x for x in r["entities"] or [] if x is not None}
        for key in {self.episodes[r["id"]]["key"] for r in new}:
            if None in key:
                continue
            old = sorted(((e["at"], i) for i, e in have.items() if e["key"] == key), reverse=True)[:1]
            chain = [i for _, i in old] + [r["id"] for r in sorted(new, key=lambda r: (r["created_at"], r["id"])) if self.episodes[r["id"]]["key"] == key]
            self.followed |= set(zip(chain[:-1], chain[1:], strict=True))


def state(store):
    return (
        sorted((r["id"], r["title"], r["content_hash"]) for r in store.episodes().collect()),
        sorted((r["id"], r["utility"]) for r in store.rows("metrics").collect()),
        sorted((r["src"], r["entity"]) for r in store.mentions().collect()),
        sorted((r["src"], r["dst"]) for r in store.rows("followed").collect()),
        sorted((r["id"], r["title"], r["replaced_by"]) for r in store.rows("history").collect()),
    )


def want(p):
    return (sorted((i, e["title"], e["hash"]) for i, e in p.episodes.items()), sorted(p.metrics.items()), sorted((i, x) for i, s in p.mentions.items() for x in s), sorted(p.followed), sorted(p.history))


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_batches_equal_a_loop_and_failures_leave_no_trace(spark, tmp_path):
    rng, plain, folder = random.Random(11), Plain(), str(tmp_path / "s")
    store, n = saves.Store(spark, f"file://{folder}"), 0
    for batch in range(4):
        rows = []
        for _ in range(25):
            n += 1
            rows.append({"id": f"e{n:03}", "path": rng.choice([None, None, f"p{rng.randrange(30)}"]), "title": f"t{n}", "content": f"text {rng.randrange(45)}", "scope": rng.choice([None, "a"]), "session_id": rng.choice([None, "u1_1", "u1_2", "u2_1"]), "task_id": rng.choice([None, "x", "y"]), "created_at": dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=rng.randrange(10_000)), "entities": rng.choice([None, [], ["A"], ["A", "B", "A", None]])})
        made = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], ROW)
        plain.save(rows)
        actions = {r["id"]: r["action"] for r in store.save(made(rows)).collect()}
        assert state(store) == want(plain) and set(actions.values()) <= {"insert", "update", "keep"}
        before, there = state(store), files(folder)
        with pytest.raises(Exception, match="no id or no content"):
            store.save(made([*rows[:3], dict(rows[0], content=None)]))
        if batch == 1:  # it fails at the last of its tables
            linked, store.linked = store.linked, lambda rows: rows.select("nothing")
            with pytest.raises(Exception, match="nothing"):
                store.save(made([dict(rows[0], id="zz", content="new", path=None)]))
            store.linked = linked
        assert files(folder) == there and state(store) == before and state(saves.Store(spark, f"file://{folder}")) == before
    names = {r["name"]: r["mentions"] for r in store.entities().collect()}
    assert names == {x: sum(x in s for s in plain.mentions.values()) for x in ("A", "B")}

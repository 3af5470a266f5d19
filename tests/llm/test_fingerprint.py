import hashlib
import random

import numpy as np

from recollect.llm import fingerprint as fp

DOCS = "doc_id long, text string, bucket string, extra long"


def shingles(t):
    return {t[i : i + 12] for i in range(max(1, len(t) - 11))} if t else set()


def text(rng, n):
    return "".join(rng.choice("abcdefgh éñ日\n") for _ in range(n))


def test_edits_and_next(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 1009 - 300, text(rng, rng.choice([0, 1, 3, 11, 12, 13, 50, 700, 9000])), "x", 1) for i in range(300)] + [(5000, None, "", 0), (-9000, "first of all, some words here", "", 0)]
    got = {r["doc_id"]: r for r in fp.edited(spark, spark.createDataFrame(rows, DOCS)).collect()}
    order = sorted((d, t or "") for d, t, *_ in rows)
    assert sorted(got) == [d for d, _ in order]
    for (d, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        r, cut = got[d], len(t) // 4
        e = t[: len(t) - cut] + u[:cut]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        for name, other in (("near_edited", e), ("near_next", u)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(r[name] - true) <= (1e-9 if len(a | b) <= fp.K else 0.2)


def test_sketches():
    rng = random.Random(9)
    a, b = text(rng, 6000), text(rng, 6000)
    both = a + b
    s, t, u = fp.sketches([a, both, b])
    assert fp.load(fp.dump(s)).tolist() == s.tolist() and fp.dump(fp.sketches([a])[0]) == fp.dump(s)
    assert np.array_equal(fp.merge(s, u)[:60], t[:60]) or abs(fp.resemblance(fp.merge(s, u), t) - 1) < 0.05
    assert abs(fp.count(t) / len(shingles(both)) - 1) < 0.35
    assert fp.contained(s, t) > 0.75 and abs(fp.contained(t, s) - 0.5) < 0.2
    assert fp.resemblance(*fp.sketches(["", ""])) == 1 and fp.resemblance(*fp.sketches(["", "x"])) == 0


def test_few_rows(spark):
    assert fp.edited(spark, spark.createDataFrame([], DOCS)).collect() == []
    one = fp.edited(spark, spark.createDataFrame([(3, "abcdefgh" * 9, "", 0)], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    rows = [(None, "some text", "", 0), (None, "other text", "", 0), (4, "a", "", 0), (4, "a", "", 0)]
    assert len(fp.edited(spark, spark.createDataFrame(rows, DOCS)).collect()) == 4


def test_an_id_that_many_rows_share_is_cut_into_parts(spark):
    rows = [(5, f"hot text number {i} of many") for i in range(600)] + [(i, f"other {i}") for i in range(100, 160)] + [(None, "none"), (None, "none too"), (4, "before")]
    made = fp.in_order(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = made.collect()
    own, extra = [r for r in got if not r["extra"]], [r for r in got if r["extra"]]
    assert len({r["bucket"] for r in own if r["doc_id"] == 5}) > 3 and sorted((str(r["doc_id"]), r["text"]) for r in own) == sorted((str(d), t) for d, t in rows)
    heads = {}
    for r in own:
        heads.setdefault(r["bucket"], []).append(((r["doc_id"] is not None, r["doc_id"]), r["text"]))
    order = sorted(heads)
    assert [max(h[0] for h in heads[a]) <= min(h[0] for h in heads[b]) for a, b in zip(order, order[1:], strict=False)].count(False) == 0
    assert {r["bucket"] for r in extra} == set(order)
    back = fp.edited(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(back) == len(rows)

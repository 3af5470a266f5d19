import random
import zlib

from recollect.llm import toxicity as tox

DOCS = "doc_id long, text string, score double, label string"


def read(text):
    return dict(zip(tox.READINGS, tox.Grammar().features([text], {})[0], strict=True))


def test_readings():
    assert read("What an idiot")["plain"] > 0 and read("You are an idiot")["aimed"] > 0
    assert read("You are not an idiot")["negated"] > 0 and read("You are not an idiot")["aimed"] == 0
    assert read("She said he is a moron")["reported"] > 0 and read('The sign: "clown"')["reported"] > 0
    assert read("I will kill you")["threat"] > 0 and read("I will not kill you")["threat_off"] > 0
    assert not any(read("They kill time. You rest.").values())  # target in another clause
    assert not any(read("").values()) and not any(read("idiotic weather").values())
    g = tox.Grammar()
    s = [float(g.score(g.features([t], {}))[0]) for t in ("A fine day", "She said idiot", "You idiot")]
    assert s[0] < s[1] < s[2] and s[0] < 0.3 <= s[2]


def fixture():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["moron", "scum", "zorg" + rng.choice("abcdef") + "u", "zorgat"])
        rows.append((i, " ".join(w), 1.0, "x"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows + [(2000, None, 0.0, ""), (2001, "", 0.0, ""), (None, "you scum", 0.0, ""), (3, rows[3][1], 0.0, ""), (2002, "moron " * 30_000, 0.0, "")], DOCS)
    got = tox.classify(spark, docs, spark.createDataFrame([*labels, (None, 1, 1), (7000, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + 5
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held if r["doc_id"] < 900} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in held if r["doc_id"] in truth) / sum(r["doc_id"] in truth for r in held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[2000]["score"] == by[2001]["score"] < 0.3 and by[None]["predicted"] == 1 and by[2002]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tox.classify(spark, docs, labels).collect() == []
    kept = tox.passing(spark.createDataFrame([(1, "you moron", 0.0, "x"), (2, None, 0.0, "y")], DOCS), tox.Grammar()).collect()
    assert [tuple(r) for r in kept] == [(2, None, 0.0, "y")]


def test_transducers_are_composed():
    n, t, i = tox.NEGATION, tox.THREAT, tox.INSULT
    assert tox.negation.read([n, 0, i, 0, i, tox.END, i]) == [0, 0, tox.NEGATED_INSULT, 0, i, tox.END, i]
    assert tox.speech.read([tox.QUOTE, tox.NEGATED_INSULT, i, t, tox.END, i]) == [0, tox.NEGATED_INSULT, tox.TOLD_INSULT, tox.TOLD_THREAT, tox.END, i]
    rng = random.Random(1)
    chain = tox.then(tox.then(tox.negation, tox.speech), tox.aim)
    other = tox.then(tox.negation, tox.then(tox.speech, tox.aim))  # composition is associative
    for _ in range(300):
        symbols = [rng.randrange(tox.INSULT + 1) for _ in range(rng.randint(0, 25))]
        want = tox.aim.read(tox.speech.read(tox.negation.read(symbols)))
        state, got = 0, []
        for x in symbols:
            got.append(tox.EMIT[state][x])
            state = tox.NEXT[state][x]
        assert chain.read(symbols) == other.read(symbols) == want == got


def test_each_reading_adds_something():
    good = ["a fine day", "you said so", "not an idiot", "he said moron", "they say clown", "i will not hurt you", "kill time", "nobody is a fool"] * 6
    bad = ["you idiot", "you are scum", "i will kill you", "moron", "you clown", "they will hurt him"] * 6
    rank = tox.ablation(good + bad, [0] * len(good) + [1] * len(bad), tox.learn([f"{t} {k}" for k, t in enumerate(good + bad)], [0] * len(good) + [1] * len(bad)))
    assert rank[""] > 0.95 and rank["plain"] < rank[""] and rank["aimed"] < rank[""] and rank["threat"] < rank[""] and set(rank) == {"", *tox.READINGS}


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(i, "moron " * 200 if i % 2 else "calm " * 200) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 0.0, "") for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    assert tox.fit(docs, labels, most_bytes=0) == tox.Grammar() and tox.fit(docs, labels, most_bytes=50_000) != tox.Grammar()

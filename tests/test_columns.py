"""Column functions on texts of their own; the oddest cases of each rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recollect.functions import columns as c
from recollect.functions import texts
from recollect.operators import lines


def values(spark, rows, *made):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ", ".join(["i int"] + [f"{x} string" for x in "ab"[: len(rows[0]) if isinstance(rows[0], tuple) else 1]]))
    out = [tuple(r)[1:] for r in df.select("i", *(m.alias(f"m{k}") for k, m in enumerate(made))).orderBy("i").collect()]
    return [r[0] for r in out] if len(made) == 1 else out


def test_markdown(spark):
    a = F.col("a")
    assert values(spark, ["[[A|x]] [[A]] [[b\\|c]] [[ d ]] [[]] [x] [[e", "[[a]b]]", "", None], c.wikilinks(a)) == [["A", "b|c", "d"], ["a]b"], [], None]
    assert values(spark, ["# H #1\n* a\n2) b\n\n***bold*** x_y_z 2*3*4", "![i](u) <i>t</i> `k`\n```\ncode\n```"], c.plain_text(a)) == ["H #1 a b bold x_y_z 2*3*4", "i t k code"]
    bodies = [("# My Title\n\nmy title\nBody\nMy Title", "My Title"), ("plan plan\nplan plan x", "notes/Plan"), ("T", "T"), ("T T T\n", "T"), ("", "T"), ("x", "")]
    assert values(spark, bodies, c.without_title(a, F.col("b"))) == ["Body\nMy Title", "plan plan x", "", "", "", "x"]
    assert values(spark, ["---\nt: 'x y'\n---\n\nb", "no\n---\nt: 1\n---", "---\nt:\n---\nz"], c.front_matter(a, "t"), c.body_of(a)) == [("x y", "b"), (None, "no\n---\nt: 1\n---"), (None, "z")]


def test_cuts(spark):
    a = F.col("a")
    long = "a" * 300 + ". " + "b" * 300
    paragraphs = "p" * 100 + "\n\n" + "q" * 100 + "\n\n" + "r" * 600
    assert values(spark, ["short", long, paragraphs, "é" * 300], c.excerpt(a)) == ["short", "a" * 300 + ".... [truncated]", "p" * 100 + "\n\n" + "q" * 100 + "... [truncated]", "é" * 250 + "... [truncated]"]
    assert values(spark, ["Hello, World!", "--", "É_x"], c.slug(a)) == ["hello_world", "rule", "é_x"]
    names = values(spark, [("Short one", "x"), ("word " * 20, "x"), ("w" * 80, "x"), ("!", "x")], c.canonical_name(a, F.col("b")))
    assert names[0].startswith("short-one-") and names[1].startswith("word-" * 13) and len(names[1]) == 64 + 1 + 8 + 3 and names[2].startswith("w" * 65 + "-") and names[3].startswith("untitled-")


def test_secrets(spark):
    said = ['password = "hunter2" x', "api_key: 'abc'", 'password = "open', "id AKIA" + "A" * 16, None, 'Token="a\'b"', "export MY_TOKEN=abc def"]
    assert values(spark, said, c.redacted(F.col("a"))) == ['password = "[REDACTED]" x', "api_key: '[REDACTED]'", 'password = "open', "id [REDACTED]", None, 'Token="[REDACTED]"', "export MY_TOKEN=[REDACTED] def"]


def test_token_estimates(spark):
    said = ["hello world", "a::b -> c", "getHTTPName_x", "aBcD\n\n", "été Été", "", "日本 x"]
    assert values(spark, said, c.token_estimate(F.col("a"))) == [texts.token_estimate(x) for x in said]


def test_paths(spark):
    said = ["/a/My.Proj/src/.git", "/home/3f2504e0-4f89-41d3-9a0c-0305e82c3301/Target", "../..y..!", "/src", "/a/Session-1"]
    assert values(spark, said, c.scope_from_path(F.col("a"))) == ["my.proj", "home", None, None, "a"]
    assert values(spark, ["u_12", "u_1234", "u_", "u_1_22", "u"], c.user_prefix(F.col("a"))) == ["u", "u_1234", "u_", "u_1", "u"]
    assert values(spark, ["S - Turn 12", "S - Turn 1 - Turn 2", "Turn 3", "S - Turn x"], c.turn_number(F.col("a"))) == [12, None, None, None]


def test_dates(spark):
    said = ["2024-02-29", "2024/2/3 4:5:6", "2023-02-29", "2024-01-01T10:00", "2024-01-01T10:00:00+05:30", "x 2024-01-01", "2024-01-01 25:00:00"]
    at = lambda *x: dt.datetime(*x)
    assert values(spark, said, c.flexible_date(F.col("a"))) == [at(2024, 2, 29), at(2024, 2, 3, 4, 5, 6), None, None, at(2024, 1, 1, 10), None, None]
    assert values(spark, ["a1700000000 1700000001", "17000000001", "[1700000002]", "x"], c.unix_time(F.col("a"))) == [1700000001, None, 1700000002, None]
    assert values(spark, ["2023/05/30 (Tue) 23:40", "2023/05/30 23:40", "2023-05-30 (Tue) 23:40"], c.haystack_date(F.col("a"))) == ["2023-05-30T23:40:00Z", None, None]


@pytest.mark.parametrize(
    ("query", "kind", "depth"),
    [("nothing here", None, None), ("it rained before dinner", "preceding", 1.0), ("Later, they left.", "succeeding", 1.0), ("the newest one", "relative", 1.0), ("which steps did you try?", "procedural", 3.0), ("which colour is it", None, None), ("much earlier than that", "preceding", 3.0), ("we ran; now what", "relative", 1.0), ("far recent", "relative", 1.0)],
)
def test_cues(spark, query, kind, depth):
    got = spark.range(1).select(c.temporal_cue(F.lit(query)).alias("x")).first()["x"]
    assert (got["kind"], got["depth"]) == (kind, depth) if kind else got is None


def test_queries(spark):
    assert values(spark, ["my hotel tomorrow", "My hotel", "(me)", "about  me", "who am i?", "hotels"], c.category(F.col("a"))) == ["Temporal", "Preference", "User", "User", "User", "Default"]
    assert values(spark, ["the day before  last summer", "lastly now"], c.without_temporal(F.col("a"))) == ["the summer", "lastly"]
    assert values(spark, ["x E0277 TS1", "TS2304", "PERMISSION denied", "lock conflict", "E12"], c.error_signature(F.col("a"))) == ["E0277", "TS2304", "permission", "lock", None]


def test_cosine(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 1.0]), (1, [1.0], [1.0, 1.0]), (2, [], []), (3, [0.0, 0.0], [1.0, 0.0])], "i int, a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.orderBy("i").select(c.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0]


def test_answers(spark):
    said = ["```\na\n```", "```json {} ```", "x ```py\nb\n``` y ```c```", "<think>\n```\n</think> z", " plain "]
    assert values(spark, said, lines.clean_answer(F.col("a"))) == ["a", "{}", "py\nb\n``` y ```c", "z", "plain"]
    assert values(spark, ["a(:|-|:) x\nb\nc(:|-|:)y", "a(:|-|:)x"], lines.titles(F.col("a"), 2)) == [["x", "y"], []]


def test_search_words(spark):
    said = ["Which motel can I book, near the Diner?", "who is it?", "?!", "word " * 20, "company lodgings", "Éa É x", ""]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", c.search_words(F.col("s")).alias("w")).collect()
    got = [r["w"] for r in sorted(rows)]
    assert got == [["hotel", "can", "book", "near", "restaurant"], ["who is it"], [], ["word"] * 8, ["work", "hotel"], ["Éa", "É"], []]


def test_what_a_question_and_a_text_share(spark):
    said = 'When did Anna and Élise meet? "not this" nor "  ", said Tom on 2024-02-30 or 2024-03-01.'
    row = spark.createDataFrame([(said,)], "s string").select(c.names(F.col("s")).alias("n"), c.quotations(F.col("s")).alias("q"), c.dates(F.col("s")).alias("d")).first()
    assert row["n"] == ["Anna", "Élise", "Tom"] and row["q"] == ["not this"] and row["d"] == [dt.date(2024, 3, 1)]
    one = spark.range(1)
    day = lambda *x: F.array(*(F.lit(v).cast("date") for v in x)) if x else F.array().cast("array<date>")
    near = one.select(c.closeness(day("2024-01-01", "2024-01-20"), day("2024-01-23")).alias("a"), c.closeness(day(), day("2024-01-01")).alias("b"), c.closeness(day("2024-01-01"), day("2025-01-01")).alias("c")).first()
    assert tuple(near) == pytest.approx((0.9, 0.0, 0.0))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0.0)
    got = one.select(c.boosted_distance(F.lit(1.0), yes, no, zero, zero, zero), c.boosted_distance(F.lit(0.5), yes, yes, F.lit(1.0), F.lit(1.0), F.lit(1.0)), c.boosted_distance(F.lit(9.0), no, no, zero, zero, zero)).first()
    assert tuple(got) == pytest.approx((0.6, -0.75, 2.0))

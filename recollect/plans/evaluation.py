"""The stored index, and many questions in one plan: each ranked against its own haystack, measured, rolled up, and the weights swept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import columns as c
from recollect.functions.words import STOP_WORDS
from recollect.operators import index, lines, ranking
from recollect.plans.registry import Tables, query
from recollect.sources import staging, transcripts

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}-]+'), lambda x: x <> '' AND x NOT IN ({STOPS}))"


# The index: documents come in three batches, some go again, some change their text.


def changed_index(t: Tables, stems: bool) -> index.Index:
    held = index.Index(t.spark, staging.new_path(t.spark, "index"), stems)
    d = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scope"), "text")
    first, later = F.col("id") % 5 > 0, F.col("id") % 11 == 0
    held.change(0, d.where(first))
    held.change(1, d.where(~first), d.where(first & (F.col("id") % 7 == 0)).select("id"))
    new = d.where(later).withColumn("text", F.concat("scope", F.lit(" "), F.coalesce("text", F.lit(""))))
    held.change(2, new, new.select("id"))
    return held


def asked_items(t: Tables) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("question"), "text")


KEPT = f"""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN source || ' ' || coalesce(text, '') ELSE text END AS text FROM documents
  WHERE doc_id % 11 = 0 OR NOT (doc_id % 5 > 0 AND doc_id % 7 = 0)),
w AS (SELECT doc_id, source, unnest({words_sql("text")}) AS term FROM d), tf AS (SELECT doc_id, source, term, count(*) AS tf FROM w GROUP BY ALL)"""
INDEX_SQL = f"""{KEPT}, q AS (SELECT DISTINCT item_id, unnest({words_sql("text")}) AS term FROM benchmark),
l AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id), n AS (SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT sum(dl) FROM l) / CAST((SELECT count(*) FROM d) AS DOUBLE) AS avgdl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT item_id, doc_id, sum(ln((n_docs - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.4e0 + 0.6e0 * dl / avgdl))) AS bm25
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (doc_id) CROSS JOIN n GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(bm25, 5) AS bm25, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""


@query("A4 A5 C1 K3 S11 S12", INDEX_SQL)
def indexed_topk(t: Tables):
    """Every benchmark item asked of the index, all in one plan, after batches that added, removed and changed documents."""
    found = changed_index(t, stems=False).top(asked_items(t), 10)
    return found.select(F.col("question").alias("item_id"), F.col("id").alias("doc_id"), F.round("bm25", 5).alias("bm25"), "rank")


@query("T1 T4 A4 K3", None)
def stemmed_topk(t: Tables):
    """The same with stems, at writing and at asking."""
    found = changed_index(t, stems=True).top(asked_items(t), 10)
    return found.select(F.col("question").alias("item_id"), F.col("id").alias("doc_id"), "bm25", "rank")


@query("A2 A4", f"{KEPT} SELECT term, source AS scope, count(*) AS document_frequency FROM tf GROUP BY term, source")
def index_frequencies(t: Tables):
    """Document frequencies of each scope, added up from the batches' changes."""
    return changed_index(t, stems=False).frequencies().select("term", "scope", F.col("df").alias("document_frequency"))


# Questions with a haystack each: ten conversations, of which one has the answer. They are written as the files that the reader takes.

KINDS = ("single", "multi", "temporal")


def question_files(t: Tables) -> str:
    turns = t("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    conv = F.col("conv_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    sessions = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    opening = F.array_join(F.slice(F.split(F.element_at("turns", 1)["content"], r"\s+"), 1, 6), " ")
    heads = sessions.select(conv.alias("q"), opening.alias("question"))
    spread = sessions.select(conv.alias("session"), "turns", F.explode(F.sequence(conv - 9, conv)).alias("q"))
    answer = F.transform("turns", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), ((F.col("session") == F.col("q")) & (m["role"] == "user")).alias("has_answer")))
    stacks = spread.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("session", answer.alias("turns")))).alias("s"))  # ten sessions
    name = lambda k: F.concat(F.lit("s"), k)
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.col("q") % 3 + 1).cast("int"))
    rows = heads.join(stacks, "q").select(
        F.col("q").cast("string").alias("question_id"), kind.alias("question_type"), "question", F.lit("2024/01/20 (Sat) 10:00").alias("question_date"), F.array(name(F.col("q"))).alias("answer_session_ids"),
        F.transform("s", lambda x: name(x["session"])).alias("haystack_session_ids"), F.transform("s", lambda x: x["turns"]).alias("haystack_sessions"),
    )
    path = staging.new_path(t.spark, "questions")
    rows.write.json(path)
    return path


HAYSTACK = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, coalesce(text, '') AS text FROM conversations),
q AS (SELECT conv_id AS q, ['single', 'multi', 'temporal'][conv_id % 3 + 1] AS kind, array_to_string(regexp_split_to_array(text, '\\s+')[1:6], ' ') AS question FROM t WHERE i = 0),
h AS (SELECT q.q, kind, t.conv_id, t.i, t.text, t.conv_id = q.q AND role = 'user' AS gold FROM q JOIN t ON t.conv_id BETWEEN q.q AND q.q + 9),
a AS (SELECT DISTINCT q, unnest({words_sql("question")}) AS term FROM q), w AS (SELECT conv_id, i, unnest({words_sql("text")}) AS term FROM t),
tf AS (SELECT conv_id, i, term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT conv_id, i, sum(tf) AS dl FROM tf GROUP BY ALL),
n AS (SELECT h.q, count(*) AS n_docs, CAST(sum(coalesce(dl, 0)) AS DOUBLE) / count(*) AS avgdl FROM h LEFT JOIN l USING (conv_id, i) GROUP BY h.q),
x AS (SELECT h.q, h.conv_id, h.i, a.term, tf, dl FROM h JOIN a USING (q) JOIN tf ON tf.conv_id = h.conv_id AND tf.i = h.i AND tf.term = a.term JOIN l ON l.conv_id = h.conv_id AND l.i = h.i),
df AS (SELECT q, term, count(*) AS df FROM x GROUP BY ALL),
b AS (SELECT x.q, conv_id, i, sum(ln((n_docs - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.4e0 + 0.6e0 * CASE WHEN avgdl > 0 THEN dl / avgdl ELSE 1 END))) AS bm25 FROM x JOIN df USING (q, term) JOIN n USING (q) GROUP BY ALL),
v AS (SELECT h.*, b.bm25, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS dot FROM h LEFT JOIN b USING (q, conv_id, i)
  LEFT JOIN embeddings e ON e.vec_id = (h.conv_id * 8 + h.i) % 500 LEFT JOIN embeddings f ON f.vec_id = (h.q * 8) % 500)"""
SCORED = """, m AS (SELECT *, min(coalesce(bm25, 0)) OVER (PARTITION BY q) AS lo, max(coalesce(bm25, 0)) OVER (PARTITION BY q) AS hi FROM v),
y AS (SELECT q, kind, conv_id, i, gold, {beta} AS beta, coalesce(dot, 0) AS dot, CASE WHEN hi - lo > 1e-6 THEN (coalesce(bm25, 0) - lo) / (hi - lo) WHEN hi > 1e-6 THEN 1 ELSE 0 END AS keyword FROM m{grid}),
z AS (SELECT *, (1 - beta) * dot + beta * keyword AS f FROM y), r AS (SELECT *, row_number() OVER (PARTITION BY beta, q ORDER BY round(f / (1 + exp(-20 * (f - 0.6e0))), 9) DESC, conv_id, i) AS rank FROM z),
g AS (SELECT beta, q, any_value(kind) AS kind, count(*) FILTER (gold) AS n_gold, count(*) FILTER (gold AND rank <= 5) AS g5, count(*) FILTER (gold AND rank <= 10) AS g10, count(*) FILTER (gold AND rank <= 25) AS g25,
  count(*) FILTER (conv_id = q AND rank <= 5) AS s5, min(rank) FILTER (gold AND rank <= 25) AS hit, coalesce(sum(1 / log2(rank + 1)) FILTER (gold AND rank <= 10), 0) AS got FROM r GROUP BY beta, q),
e AS (SELECT beta, kind, q, CAST(g5 > 0 AS INT) AS any_turn_5, CAST(g5 = n_gold AND n_gold > 0 AS INT) AS all_turn_5,
  CASE WHEN n_gold > 0 THEN got / list_sum(list_transform(range(1, CAST(least(10, n_gold) AS BIGINT) + 1), lambda k: 1 / log2(k + 1))) ELSE 0 END AS ndcg_10, CAST(g10 > 0 AS INT) AS any_turn_10,
  CAST(g25 = n_gold AND n_gold > 0 AS INT) AS all_turn_25, CAST(s5 > 0 AS INT) AS any_session_5, CAST(s5 > 0 AS INT) AS all_session_5, coalesce(1e0 / hit, 0) AS reciprocal, CAST(hit IS NULL OR hit >= 5 AS INT) AS penalty FROM g)"""
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ranking.MEASURES)


def haystacks(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(questions, their haystacks' turns with bm25 and dot), read from files. A row's place (session, turn) names it."""
    path = question_files(t)
    asked = staging.staged(transcripts.asked(t.spark, path, lines=True).withColumn("question", F.col("question_id")), "asked")  # the files are long, their heads aren't
    turns = transcripts.questions(t.spark, path, lines=True)
    conv = F.substring("session_id", 2, 20).cast("long")
    rows = turns.select(F.col("question_id").alias("question"), F.struct(conv.alias("conv"), "turn").alias("id"), F.col("session_id").alias("session"), F.col("question").alias("said"), "text", F.col("has_answer").alias("gold"))
    rows = staging.staged(rows.withColumn("w", lines.terms(F.col("text"))).withColumn("dl", F.size("w")), "haystacks")
    numbers = rows.groupBy("question").agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    found = rows.withColumn("a", F.array_distinct(lines.terms(F.col("said")))).where(F.arrays_overlap("a", "w"))
    hits = found.select("question", "id", F.col("dl").cast("long").alias("dl"), "w", F.explode("a").alias("term"))
    hits = hits.withColumn("tf", F.size(F.filter("w", lambda x: x == F.col("term")))).where("tf > 0").drop("w")
    scores = ranking.bm25(hits, numbers, ["question"])
    vec = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    keyed = rows.drop("said", "text", "w").join(scores, ["question", "id"], "left").withColumn("vec_id", (F.col("id.conv") * 8 + F.col("id.turn")) % 500).join(vec, "vec_id", "left")
    asked_vec = vec.select(F.col("vec_id").alias("q_vec"), F.col("e").alias("qe"))
    keyed = keyed.withColumn("q_vec", F.col("question").cast("long") * 8 % 500).join(asked_vec, "q_vec", "left")
    dot = F.aggregate(F.zip_with("e", "qe", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gold = F.array_contains("answer_session_ids", F.col("session"))
    out = keyed.join(asked.select("question", "answer_session_ids"), "question").select("question", "id", "session", "gold", gold.alias("gold_session"), "bm25", dot.alias("dot"))
    return asked, staging.staged(out, "scored-haystacks")


def evaluated(rows: DataFrame, asked: DataFrame, betas: DataFrame | None = None, beta: Column | None = None) -> DataFrame:
    """Measures of each question, and of each `beta` of a grid."""
    by = ["question"] if betas is None else ["beta", "question"]
    frame = rows.groupBy("question").agg(F.count_if("gold").alias("n_gold")).join(asked.select("question", F.size("answer_session_ids").alias("n_sessions")), "question")
    rows = rows.withColumn("keyword", ranking.keyword_share(["question"]))  # deals the rows by question, before each of them is there for every weight
    if betas is not None:  # a few numbers
        rows, frame, beta = rows.crossJoin(F.broadcast(betas)), frame.crossJoin(F.broadcast(betas)), F.col("beta")
    scored = rows.withColumn("score", ranking.blended(F.col("keyword"), beta, F.lit(20.0), F.lit(0.6)))
    return ranking.measured(ranking.first(scored, by, "score", 25, "id"), frame, by)


@query("C18 SP V1 V3 V4 S10 S13", HAYSTACK + SCORED.format(beta="0.4e0", grid="") + " SELECT CAST(q AS VARCHAR) AS question, " + ", ".join(f"round({m}, 6) AS {m}" for m in ranking.MEASURES) + " FROM e")
def haystack_eval(t: Tables):
    """Every question ranked against its own haystack and measured, all in one plan."""
    asked, rows = haystacks(t)
    return evaluated(rows, asked, beta=F.lit(0.4)).select("question", *(F.round(m, 6).alias(m) for m in ranking.MEASURES))


@query("A8 V1", HAYSTACK + SCORED.format(beta="0.4e0", grid="") + f" SELECT coalesce(kind, 'all') AS question_type, count(*) AS questions, {MEANS} FROM e GROUP BY ROLLUP (kind)")
def haystack_rollup(t: Tables):
    """The measures' means, by type of question and overall."""
    asked, rows = haystacks(t)
    return ranking.rolled_up(evaluated(rows, asked, beta=F.lit(0.4)).join(asked.select("question", "question_type"), "question"), "question_type")


GRID = [k / 10 for k in range(11)]
GRID_SQL = HAYSTACK + SCORED.format(beta="p.beta", grid=", (SELECT unnest(range(11)) / 10e0 AS beta) p")


@query("V8 V5", GRID_SQL + f", s AS (SELECT beta, {', '.join(f'avg({m}) AS {m}' for m in ranking.MEASURES)} FROM e GROUP BY beta) SELECT beta, round(0.5e0 * ndcg_10 + 0.4e0 * all_turn_5 + 0.1e0 * any_turn_5, 6) AS coarse, round(0.5e0 * ndcg_10 + 0.3e0 * all_turn_5 + 0.2e0 * any_turn_5 - 0.1e0 * penalty, 6) AS fine, any_turn_5 < (SELECT any_turn_5 FROM s WHERE beta = 0.4e0) - 0.02e0 AS vetoed FROM s")
def weight_grid(t: Tables):
    """A sweep over the weight of keywords: candidates are scored once, all weights rank them in one plan; a weight that loses recall to the one in use is vetoed."""
    asked, rows = haystacks(t)
    betas = t.spark.createDataFrame([(b,) for b in GRID], "beta double")
    means = evaluated(rows, asked, betas).groupBy("beta").agg(*(F.avg(m).alias(m) for m in ranking.MEASURES))
    now = means.where("beta = 0.4").select(F.col("any_turn_5").alias("now"))
    return means.crossJoin(F.broadcast(now)).select("beta", F.round(ranking.objective(False), 6).alias("coarse"), F.round(ranking.objective(True), 6).alias("fine"), (F.col("any_turn_5") < F.col("now") - 0.02).alias("vetoed"))


def narrowed(rows: DataFrame, asked: DataFrame, low: float, high: float, rounds: int) -> list[tuple[float, float]]:
    """Ternary search for the weight with the greatest fine objective: (weight, value) of all points tried. Each round measures two points in one plan."""
    spark, tried = rows.sparkSession, []
    for _ in range(rounds):
        points = [low + (high - low) / 3, high - (high - low) / 3]
        betas = spark.createDataFrame([(round(b, 9),) for b in points], "beta double")
        means = evaluated(rows, asked, betas).groupBy("beta").agg(*(F.avg(m).alias(m) for m in ranking.MEASURES)).select("beta", F.round(ranking.objective(True), 9).alias("value"))
        found = sorted((r["beta"], r["value"]) for r in means.collect())  # two rows
        tried += found
        low, high = (points[0], high) if found[0][1] < found[1][1] else (low, points[1])
    return tried


@query("V8", None)
def weight_search(t: Tables):
    """The same weight by ternary search over real measures."""
    asked, rows = haystacks(t)
    return t.spark.createDataFrame(narrowed(rows, asked, 0.0, 1.0, 4), "beta double, value double")


GATE_SQL = HAYSTACK + SCORED.format(beta="p.beta", grid=", (VALUES (0.4e0), (0.6e0)) p(beta)") + """, s AS (SELECT beta, unnest(['ndcg_10', 'any_turn_5', 'all_turn_5']) AS measure, unnest([avg(ndcg_10), avg(any_turn_5), avg(all_turn_5)]) AS v FROM e GROUP BY beta)
SELECT a.measure, round(a.v, 6) AS base, round(b.v, 6) AS now, CASE WHEN b.v < a.v - 0.0001e0 THEN 'fail' ELSE 'pass' END AS verdict FROM s a JOIN s b ON a.measure = b.measure AND a.beta = 0.4e0 AND b.beta = 0.6e0"""


@query("V7", GATE_SQL)
def weight_gate(t: Tables):
    """A change of the weight against the measures of the weight in use: a loss fails."""
    asked, rows = haystacks(t)
    betas = t.spark.createDataFrame([(0.4,), (0.6,)], "beta double")
    means = evaluated(rows, asked, betas).groupBy("beta").agg(*(F.avg(m).alias(m) for m in ("ndcg_10", "any_turn_5", "all_turn_5")))
    long = means.select("beta", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("ndcg_10", "any_turn_5", "all_turn_5")))).alias("m")).select("beta", "m.*")
    both = long.where("beta = 0.4").select("measure", F.col("v").alias("base")).join(long.where("beta = 0.6").select("measure", F.col("v").alias("now")), "measure")
    return both.select("measure", F.round("base", 6).alias("base"), F.round("now", 6).alias("now"), F.when(F.col("now") < F.col("base") - 0.0001, "fail").otherwise("pass").alias("verdict"))


BOOSTED = f"""WITH f AS (SELECT conv_id, array_to_string(regexp_split_to_array(coalesce(text, ''), '\\s+')[1:3], ' ') AS quote FROM conversations WHERE turn = 0),
q AS (SELECT conv_id, quote, 'When did ' || CASE conv_id % 2 WHEN 0 THEN 'Anna' ELSE 'Berta' END || ' say "' || quote || '" near 2024-01-' || (10 + conv_id % 10) || '?' AS question FROM f),
t AS (SELECT conv_id, turn, 'Note of 2024-01-' || (10 + turn) || ' by ' || CASE turn % 2 WHEN 0 THEN 'Anna' ELSE 'Berta' END || ': ' || coalesce(text, '') AS content FROM conversations),
b AS (SELECT t.*, q.quote, list_distinct({words_sql("question")}) AS a, {words_sql("content")} AS w, 1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS base
  FROM t JOIN q USING (conv_id) JOIN embeddings e ON e.vec_id = (t.conv_id * 8 + t.turn) % 500 JOIN embeddings f ON f.vec_id = (t.conv_id * 8 + 7) % 500)
SELECT conv_id, turn, round(least(2, greatest(-2, base - CASE WHEN conv_id % 2 = turn % 2 THEN 0.4e0 * base ELSE 0 END - CASE WHEN trim(quote) <> '' AND contains(content, quote) THEN 0.6e0 * base ELSE 0 END
  - 0.2e0 * greatest(0, 1 - abs(conv_id % 10 - turn) / 30e0) - 0.3e0 * len(list_intersect(a, w)) / len(a))), 6) AS distance FROM b"""


@query("S15 T18", BOOSTED)
def text_boosts(t: Tables):
    """Distances of a conversation's turns to a question about it, less what is found in both texts: a name, a quotation, dates, words."""
    k, n, said = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    name = lambda x: F.when(x % 2 == 0, "Anna").otherwise("Berta")
    turns = t("conversations")
    opening = turns.where("turn = 0").select("conv_id", F.array_join(F.slice(F.split(said, r"\s+"), 1, 3), " ").alias("quote"))
    asked = opening.select("conv_id", F.concat(F.lit("When did "), name(k), F.lit(' say "'), "quote", F.lit('" near 2024-01-'), 10 + k % 10, F.lit("?")).alias("question"))
    rows = turns.select("conv_id", "turn", F.concat(F.lit("Note of 2024-01-"), 10 + n, F.lit(" by "), name(n), F.lit(": "), said).alias("content")).join(asked, "conv_id")
    vec = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("vec_id", (k * 8 + n) % 500).join(vec, "vec_id").withColumn("q_vec", (k * 8 + 7) % 500).join(vec.select(F.col("vec_id").alias("q_vec"), F.col("e").alias("qe")), "q_vec")
    base = 1 - F.aggregate(F.zip_with("e", "qe", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q, content = F.col("question"), F.col("content")
    words = F.array_distinct(lines.terms(q))
    overlap = F.size(F.array_intersect(words, lines.terms(content))) / F.size(words)
    found = c.boosted_distance(base, F.arrays_overlap(c.names(q), c.names(content)), F.exists(c.quotations(q), lambda x: F.contains(content, x)), c.closeness(c.dates(q), c.dates(content)), overlap, F.lit(0.0))
    return rows.select("conv_id", "turn", F.round(found, 6).alias("distance"))

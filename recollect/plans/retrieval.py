"""Keyword and vector search, fusion, evaluation. The corpus is split into words once a query, however often its counts are used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.words import STOP_WORDS
from recollect.operators import lines, ranks, vectors
from recollect.plans import catalog, dialect
from recollect.plans.catalog import PLANS, QUERY
from recollect.plans.registry import Tables, query

K1, B = 1.2, 0.6


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def counted(docs: DataFrame, key: str, text: str, wanted: tuple[str, ...]) -> DataFrame:
    """Per document its length and the count of each wanted term: a few numbers, dealt by key, so that all uses of them share one pass
    over the texts."""
    words = docs.select(key, F.coalesce(lines.terms(F.col(text)), F.array().cast("array<string>")).alias("t"))
    counts = [F.size(F.filter("t", (lambda w: lambda x: x == w)(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    return words.select(key, F.size("t").alias("dl"), *counts).repartition(key)


def corpus(held: DataFrame, n: int) -> DataFrame:
    """One row: documents, mean length, documents that have each term."""
    return held.agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n)))


def idf(i: int) -> Column:
    return F.ln((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)


def bm25(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: tuple[str, ...] = QUERY) -> DataFrame:
    """key, bm25 and the corpus' numbers, of documents with one of the terms."""
    n = len(wanted)
    held = counted(docs, key, text, wanted)
    both = held.crossJoin(F.broadcast(corpus(held, n)))  # one row
    ratio = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(1.0)
    score = total([F.when(F.col(f"tf{i}") > 0, idf(i) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * ratio))).otherwise(0.0) for i in range(n)])
    return both.where(total([F.col(f"tf{i}") for i in range(n)]) > 0).withColumn("bm25", score)


def normalised(scored: DataFrame) -> DataFrame:
    """`score`: bm25 between 0 and 1."""
    ends = scored.agg(F.min("bm25").alias("low"), F.max("bm25").alias("high"))
    span = F.col("high") - F.col("low")
    return scored.crossJoin(F.broadcast(ends)).withColumn("score", F.when(span > 1e-6, (F.col("bm25") - F.col("low")) / span).when(F.col("high") > 1e-6, 1.0).otherwise(0.0))


def near(t: Tables) -> DataFrame:
    """vec_id, label and dot product with vector 0."""
    e = t("embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.where("vec_id <> 0").crossJoin(F.broadcast(probe)).select("vec_id", "label", dot.alias("sim"))


@query("C1 T2 A5 S11 S12 K1", PLANS["bm25_topk"].duck())
def bm25_topk(t: Tables):
    return bm25(t("documents")).select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(10)


@query("K3", f"WITH {dialect.render(catalog.BM25, dialect.DUCK)} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored ORDER BY round(bm25, 6) DESC, doc_id LIMIT 200")
def bm25_pool(t: Tables):
    """The keyword pool of a search."""
    return bm25(t("documents")).select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(200)


@query("S13 A6", PLANS["bm25_normalized"].duck())
def bm25_normalized(t: Tables):
    return normalised(bm25(t("documents"))).select("doc_id", F.round("score", 6).alias("score"))


@query("A4", """WITH t AS (SELECT doc_id, source, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}-]+'), lambda x: x <> ''))) AS term FROM documents), s(w) AS (SELECT unnest([""" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "])) SELECT term, source AS scope, count(*) AS document_frequency FROM t ANTI JOIN s ON t.term = s.w GROUP BY term, source")
def idf_index(t: Tables):
    """Documents of a scope that have a term; all terms."""
    return t("documents").select(F.col("source").alias("scope"), F.explode(F.array_distinct(lines.terms(F.col("text")))).alias("term")).groupBy("term", "scope").agg(F.count("*").alias("document_frequency"))


@query("A2", PLANS["term_df_two_scopes"].duck())
def term_df_two_scopes(t: Tables):
    """Summed over the index of two scopes."""
    index = idf_index(t).where(F.col("scope").isin("src0", "src1"))
    return index.groupBy("term").agg(F.sum("document_frequency").alias("document_frequency"))


@query("A5", PLANS["document_lengths"].duck())
def document_lengths(t: Tables):
    held = counted(t("documents"), "doc_id", "text", ())
    return held.crossJoin(F.broadcast(corpus(held, 0))).where("dl > 0").select("doc_id", F.col("dl").cast("long").alias("dl"), F.round(F.col("dl") / F.col("avgdl"), 6).alias("ratio"))


def sentence_cosine(rows: DataFrame, key: str, text: str, wanted: tuple[str, ...]) -> DataFrame:
    """Per row the greatest cosine of a sentence with the query: the query's terms weigh idf, a sentence's tf times idf, or tf for other
    terms. rows: key, text and idf0.. of the terms; a pool, so bounded."""
    n = len(wanted)
    parts = rows.select("*", F.posexplode(F.split(F.lower(text), r"[.\n]")).alias("at", "sentence")).withColumn("w", lines.terms(F.col("sentence"))).where(F.size("w") > 0)
    tf = [F.size(F.filter("w", (lambda w: lambda x: x == w)(w))) for w in wanted]
    dot = total([tf[i] * F.col(f"idf{i}") * F.col(f"idf{i}") for i in range(n)])
    others = F.filter("w", lambda x: ~x.isin(list(wanted)))
    squares = F.aggregate(F.transform(F.array_distinct(others), lambda x: F.pow(F.size(F.filter(others, lambda y: y == x)), 2)), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(squares + total([F.pow(tf[i] * F.col(f"idf{i}"), 2) for i in range(n)]))
    asked = F.sqrt(total([F.pow(F.col(f"idf{i}"), 2) for i in range(n)]))
    cosine = F.when((asked < 1e-9) | (length < 1e-9), 0.0).otherwise(dot / (length * asked))
    return parts.groupBy(key).agg(F.max(cosine).alias("cosine"))


@query("S14", PLANS["sentence_rerank"].duck())
def sentence_rerank(t: Tables):
    """The pool's scores and a tenth of their best sentence's cosine. Only the pool's texts are cut into sentences."""
    wanted = QUERY
    pool = bm25(t("documents")).select("doc_id", "bm25", *(idf(i).alias(f"idf{i}") for i in range(len(wanted)))).orderBy(F.round("bm25", 9).desc(), "doc_id").limit(20)
    texts = t("documents").select("doc_id", "text").join(F.broadcast(pool), "doc_id")
    cosines = sentence_cosine(texts, "doc_id", "text", wanted)
    return pool.join(cosines, "doc_id", "left").select("doc_id", F.round(F.col("bm25") + 0.1 * F.coalesce("cosine", F.lit(0.0)), 6).alias("score"))


@query("J1 S10 S13", PLANS["adaptive_fusion"].duck())
def adaptive_fusion(t: Tables):
    """Vector and keyword scores in a mixture that follows how rare the query's terms are, through a gate."""
    n = len(QUERY)
    keyword = normalised(bm25(t("documents")))
    known = total([F.when(F.col(f"df{i}") > 0, idf(i)).otherwise(0.0) for i in range(n)]) / total([F.when(F.col(f"df{i}") > 0, 1).otherwise(0) for i in range(n)])
    beta = F.greatest(F.lit(0.2), F.least(F.lit(0.8), 0.2 + 0.15 * F.greatest(F.lit(0.0), known - 2.5)))
    mixture = keyword.select(beta.alias("beta")).limit(1)
    kw = keyword.select(F.col("doc_id").alias("id"), "score")
    both = near(t).select(F.col("vec_id").alias("id"), "sim").join(kw, "id", "full_outer").crossJoin(F.broadcast(mixture))
    fused = (1 - F.col("beta")) * F.coalesce("sim", F.lit(0.0)) + F.col("beta") * F.coalesce("score", F.lit(0.0))
    return both.select("id", F.round(fused / (1 + F.exp(-20 * (fused - 0.6))), 6).alias("score"))


FUSED = f"""WITH {dialect.render(catalog.BM25, dialect.DUCK)}, {dialect.render(catalog.VECTOR, dialect.DUCK)},
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS r FROM scored),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(sim, 9) DESC, vec_id) AS r FROM near)
SELECT coalesce(a.id, b.id) AS id, round((coalesce(1e0 / (60 + a.r), 0) + coalesce(1e0 / (60 + b.r), 0)) / (2e0 / 61), 6) AS score FROM a FULL JOIN b ON a.id = b.id"""


@query("W3", FUSED)
def rrf_fusion(t: Tables):
    """Reciprocal ranks of all rows that the keywords or the vector find."""
    words = bm25(t("documents")).select(F.col("doc_id").alias("id"), (-F.round("bm25", 9)).alias("s"))
    close = near(t).select(F.col("vec_id").alias("id"), (-F.round("sim", 9)).alias("s"))
    share = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    both = ranks.numbered(words, "s", "id", name="a").select("id", "a").join(ranks.numbered(close, "s", "id", name="b").select("id", "b"), "id", "full_outer")
    return both.select("id", F.round((share("a") + share("b")) / (2.0 / 61), 6).alias("score"))


@query("W1 W2", PLANS["rank_ladder"].duck())
def rank_ladder(t: Tables):
    """Only the first five have a bonus, so only they are ranked."""
    rows = near(t).withColumn("s", F.round("sim", 9))
    first = rows.orderBy(F.desc("s"), "vec_id").limit(5).select("vec_id", F.row_number().over(Window.orderBy(F.desc("s"), "vec_id")).alias("k"))
    bonus = F.coalesce(F.element_at(F.array(*(F.lit(x) for x in (0.15, 0.10, 0.06, 0.03, 0.01))), F.col("k")), F.lit(0.0))
    return rows.join(F.broadcast(first), "vec_id", "left").select("vec_id", F.round(F.col("sim") + 0.15 * F.when(F.col("k").isNull(), 0.0).otherwise(bonus), 6).alias("score"))


@query("K2 S4", PLANS["knn_cosine"].duck())
def knn_cosine(t: Tables):
    return near(t).orderBy(F.round("sim", 9).desc(), "vec_id").limit(50).select("vec_id", F.round("sim", 5).alias("sim"))


@query("K2 K4", """WITH n AS (SELECT label, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS s
  FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id <> 0), c AS (SELECT * FROM n
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= 50) SELECT label, vec_id FROM c ORDER BY s DESC, vec_id LIMIT 75""")
def pooled_candidates(t: Tables):
    """The 50 nearest of each table, and of all these five times the limit."""
    w = Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")
    kept = near(t).withColumn("s", F.round("sim", 9)).withColumn("k", F.row_number().over(w)).where("k <= 50")
    return kept.orderBy(F.desc("s"), "vec_id").limit(75).select("label", "vec_id")


@query("W13", PLANS["every_tenth"].duck())
def every_tenth(t: Tables):
    return ranks.numbered(t("events").select("event_id"), "event_id").where("(k - 1) % 10 = 0").select("event_id")


# Evaluation: queries are the vectors whose id is divisible by 100, searched against all vectors in blocks.


def nearest(t: Tables, k: int = 10) -> DataFrame:
    """query_id, gold (its label), vec_id, label, rank."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = vectors.top_k(e, e.where("id % 100 = 0"), k)
    labels = t("embeddings").select("vec_id", "label")
    return found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id").join(labels.select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", "gold", F.col("id").alias("vec_id"), "label", "rank")


def golds(t: Tables) -> DataFrame:
    return t("embeddings").groupBy(F.col("label").alias("gold")).agg((F.count("*") - 1).alias("n"))


@query("V1", PLANS["recall_at_5"].duck())
def recall_at_5(t: Tables):
    hit = ((F.col("label") == F.col("gold")) & (F.col("rank") <= 5)).cast("int")
    return nearest(t).join(golds(t), "gold").groupBy("query_id").agg(F.max(hit).alias("recall_any"), F.round(F.sum(hit) / F.least(F.lit(5), F.max("n")), 6).alias("recall"))


FEW = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id,
  round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s), g AS (SELECT query_id, vec_id, rank FROM r
  WHERE rank IN (1, 4, 9) AND (query_id // 100 + rank) % 3 > 0)"""


@query("V1", FEW + """ SELECT query_id, max(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS any_5, min(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS all_5, max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS any_10 FROM g GROUP BY query_id""")
def recall_any_all(t: Tables):
    """Whether any and whether all of a query's gold rows are among the first; gold: some of its neighbours."""
    found = nearest(t)
    gold = found.where("rank IN (1, 4, 9) AND (query_id DIV 100 + rank) % 3 > 0").select("query_id", "vec_id")
    met = gold.join(found.select("query_id", "vec_id", "rank"), ["query_id", "vec_id"], "left")
    within = lambda k: F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
    return met.groupBy("query_id").agg(F.max(within(5)).alias("any_5"), F.min(within(5)).alias("all_5"), F.max(within(10)).alias("any_10"))


@query("V3", PLANS["ndcg_binary"].duck())
def ndcg_binary(t: Tables):
    gain = F.when(F.col("label") == F.col("gold"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.max("n")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return nearest(t).join(golds(t), "gold").groupBy("query_id").agg(F.round(F.sum(gain) / ideal, 6).alias("ndcg"))


@query("V2", PLANS["ndcg_graded"].duck())
def ndcg_graded(t: Tables):
    rel = F.when(F.col("label") == F.col("gold"), 3).when(F.col("label") % 2 == F.col("gold") % 2, 2).otherwise(0)
    graded = nearest(t).withColumn("rel", rel)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank"))
    sums = graded.withColumn("best", best).groupBy("query_id").agg(F.sum("rel").alias("all"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("got"), F.sum(F.col("rel") / F.log2(F.col("best") + 1)).alias("ideal"))
    return sums.select("query_id", F.round(F.when(F.col("all") == 0, 0.0).otherwise(F.col("got") / F.col("ideal")), 6).alias("ndcg"))


@query("V4", PLANS["mrr_penalty"].duck())
def mrr_penalty(t: Tables):
    hit = F.min(F.when(F.col("label") == F.col("gold"), F.col("rank")))
    rows = nearest(t).groupBy("query_id").agg(hit.alias("hit"))
    return rows.select("query_id", F.round(F.coalesce(1.0 / F.col("hit"), F.lit(0.0)), 6).alias("reciprocal"), F.when(F.col("hit") <= 3, 1).otherwise(0).alias("recall_3"), F.when(F.col("hit").isNull() | (F.col("hit") >= 5), 1).otherwise(0).alias("penalty"))


@query("V8", PLANS["parameter_sweep"].duck())
def parameter_sweep(t: Tables):
    found = nearest(t)
    hit = lambda k: F.max(F.when((F.col("label") == F.col("gold")) & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"k{k}")
    means = found.groupBy("query_id").agg(*(hit(k) for k in (1, 3, 5, 10))).agg(*(F.avg(f"k{k}").alias(f"k{k}") for k in (1, 3, 5, 10)))
    return means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(f"k{k}", 6).alias("recall_any")) for k in (1, 3, 5, 10)))).alias("r")).select("r.*").where("recall_any IS NOT NULL")


MEASURES = """WITH m AS (SELECT query_id, max(ndcg) AS ndcg, max(a) AS any_5, max(l) AS all_5, max(p) AS penalty
  FROM (SELECT vec_id AS query_id, (vec_id % 7) / 7e0 AS ndcg, CASE WHEN vec_id % 3 > 0 THEN 1 ELSE 0 END AS a, CASE WHEN vec_id % 5 = 0 THEN 1
  ELSE 0 END AS l, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS p FROM embeddings) x GROUP BY query_id)"""


def measures(t: Tables) -> DataFrame:
    i = F.col("vec_id")
    return t("embeddings").select(i.alias("query_id"), (i % 7 / 7.0).alias("ndcg"), (i % 3 > 0).cast("int").alias("any_5"), (i % 5 == 0).cast("int").alias("all_5"), (i % 4 == 0).cast("int").alias("penalty"))


@query("V5", MEASURES + """ SELECT round(0.5e0 * avg(ndcg) + 0.4e0 * avg(all_5) + 0.1e0 * avg(any_5), 6) AS coarse, round(0.5e0 * avg(ndcg) + 0.3e0 * avg(all_5) + 0.2e0 * avg(any_5) - 0.1e0 * avg(penalty), 6) AS fine, avg(any_5) < 0.66e0 - 0.02e0 AS coarse_veto, avg(any_5) < 0.66e0 - 0.05e0 AS fine_veto FROM m""")
def objective(t: Tables):
    """What a sweep maximises, in a coarse and a fine form, and whether a loss of recall vetoes it."""
    mean = measures(t).agg(*(F.avg(c).alias(c) for c in ("ndcg", "any_5", "all_5", "penalty")))
    n, a, l, p = (F.col(c) for c in ("ndcg", "any_5", "all_5", "penalty"))  # noqa: E741
    return mean.select(F.round(0.5 * n + 0.4 * l + 0.1 * a, 6).alias("coarse"), F.round(0.5 * n + 0.3 * l + 0.2 * a - 0.1 * p, 6).alias("fine"), (a < 0.66 - 0.02).alias("coarse_veto"), (a < 0.66 - 0.05).alias("fine_veto"))


@query("V7", MEASURES + """, b(measure, base) AS (VALUES ('ndcg', 0.5e0), ('any_5', 0.6e0), ('all_5', 0.2e0), ('latency', 80e0)),
  c AS (SELECT 'ndcg' AS measure, avg(ndcg) AS now FROM m UNION ALL SELECT 'any_5', avg(any_5) FROM m UNION ALL SELECT 'all_5', avg(all_5) FROM m
  UNION ALL SELECT 'latency', 95e0) SELECT measure, round(now, 6) AS now, CASE WHEN measure = 'latency' THEN CASE
  WHEN now > base * 1.15e0 THEN 'warn' ELSE 'pass' END WHEN now < base - 0.0001e0 THEN 'fail' ELSE 'pass' END AS verdict FROM c JOIN b USING (measure)""")
def regression_gate(t: Tables):
    """Measures against a baseline: a loss fails, a slower run only warns."""
    base = t.spark.createDataFrame([("ndcg", 0.5), ("any_5", 0.6), ("all_5", 0.2), ("latency", 80.0)], "measure string, base double")
    mean = measures(t).agg(*(F.avg(c).alias(c) for c in ("ndcg", "any_5", "all_5"))).withColumn("latency", F.lit(95.0))
    now = mean.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("now")) for c in ("ndcg", "any_5", "all_5", "latency")))).alias("m")).select("m.*")
    slow, lost = F.col("now") > F.col("base") * 1.15, F.col("now") < F.col("base") - 0.0001
    verdict = F.when(F.col("measure") == "latency", F.when(slow, "warn").otherwise("pass")).when(lost, "fail").otherwise("pass")
    return now.join(F.broadcast(base), "measure").select("measure", F.round("now", 6).alias("now"), verdict.alias("verdict"))

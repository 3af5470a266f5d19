"""Ranking of many questions at once, each against its own rows or all against one corpus: no loop over questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.2, 0.6


def bm25(hits: DataFrame, numbers: DataFrame, per: list[str], counts: DataFrame | None = None) -> DataFrame:
    """question, id, bm25. hits: question, id, term, tf, dl, a row for each term of a question that a row of its corpus has; numbers: n_docs and
    avgdl by `per` (the columns that name a corpus; none for one corpus). Document frequencies are those of `counts` (term, df), or else
    counted in the hits."""
    if counts is None:
        counts = hits.groupBy("question", "term").agg(F.count("*").alias("df"))
    met = hits.join(counts, [c for c in ("question", "term") if c in counts.columns])
    met = met.join(numbers, per) if per else met.crossJoin(F.broadcast(numbers))  # one row
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    ratio = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(1.0)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * ratio))
    return met.groupBy("question", "id").agg(F.sum(part).alias("bm25"))


def first(rows: DataFrame, by: list[str], score: str, k: int, *ties: str) -> DataFrame:
    """The first k rows of each group with their rank; scores count to nine places, equal ones by `ties`."""
    order = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_share(by: list[str]) -> Column:
    """`bm25` (null: none), spread over 0 to 1 within the group."""
    w = Window.partitionBy(*by)
    low, high = F.min(F.coalesce("bm25", F.lit(0.0))).over(w), F.max(F.coalesce("bm25", F.lit(0.0))).over(w)
    return F.when(high - low > 1e-6, (F.coalesce("bm25", F.lit(0.0)) - low) / (high - low)).when(high > 1e-6, 1.0).otherwise(0.0)


def blended(keyword: Column, beta: Column, steep: Column, centre: Column) -> Column:
    """Score of `dot` (null: none) and a keyword share: mixed by `beta`, and sent through a gate."""
    mixed = (1 - beta) * F.coalesce("dot", F.lit(0.0)) + beta * keyword
    return mixed / (1 + F.exp(-steep * (mixed - centre)))


def measured(ranked: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """Per question (and further columns of `by`, as of a parameter grid) recall of turns and of sessions, nDCG and the first hit.

    ranked: by, session, gold, gold_session, rank; asked: by, n_gold, n_sessions. A session is found if one of its turns is among the first. A
    question without gold rows, or of which nothing was found, has 0 everywhere."""
    within = lambda k: F.count_if(F.col("gold") & (F.col("rank") <= k))
    gain = F.when(F.col("gold") & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    sessions = F.count_distinct(F.when(F.col("gold_session") & (F.col("rank") <= 5), F.col("session")))
    found = ranked.groupBy(*by).agg(*(within(k).alias(f"g{k}") for k in (5, 10, 25)), F.sum(gain).alias("got"), sessions.alias("s5"), F.min(F.when(F.col("gold"), F.col("rank"))).alias("hit"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    all_of = lambda n, of: ((F.coalesce(n, F.lit(0)) == F.col(of)) & (F.col(of) > 0)).cast("double")
    any_of = lambda n: (F.coalesce(n, F.lit(0)) > 0).cast("double")
    return asked.join(found, by, "left").select(
        *by,
        any_of("g5").alias("any_turn_5"),
        all_of("g5", "n_gold").alias("all_turn_5"),
        F.when(F.col("n_gold") > 0, F.coalesce("got", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg_10"),
        any_of("g10").alias("any_turn_10"),
        all_of("g25", "n_gold").alias("all_turn_25"),
        any_of("s5").alias("any_session_5"),
        all_of("s5", "n_sessions").alias("all_session_5"),
        F.coalesce(1.0 / F.col("hit"), F.lit(0.0)).alias("reciprocal"),
        (F.col("hit").isNull() | (F.col("hit") >= 5)).cast("double").alias("penalty"),
    )


MEASURES = ["any_turn_5", "all_turn_5", "ndcg_10", "any_turn_10", "all_turn_25", "any_session_5", "all_session_5", "reciprocal", "penalty"]


def rolled_up(measures: DataFrame, kind: str) -> DataFrame:
    """Means of all measures, of each type and overall ('all'), in one pass."""
    means = [F.round(F.avg(m), 6).alias(m) for m in MEASURES]
    return measures.rollup(kind).agg(F.grouping(kind).alias("_all"), F.count("*").alias("questions"), *means).where("questions > 0").withColumn(kind, F.when(F.col("_all") == 1, "all").otherwise(F.col(kind))).drop("_all")


def objective(fine: bool) -> Column:
    """What a sweep maximises."""
    coarse = 0.5 * F.col("ndcg_10") + 0.4 * F.col("all_turn_5") + 0.1 * F.col("any_turn_5")
    return 0.5 * F.col("ndcg_10") + 0.3 * F.col("all_turn_5") + 0.2 * F.col("any_turn_5") - 0.1 * F.col("penalty") if fine else coarse

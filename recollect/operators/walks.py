"""Folds along an order that are composed from parts: a group is folded in pieces of bounded size, and the pieces' functions are put
together, so that no task needs a whole group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = 1 << 40


def _pieces(rows: DataFrame, key: str, order: list[str], piece: Column, value: str):
    """Sorted values of each piece; `piece` must follow the order."""
    sorted_values = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return rows.groupBy(key, piece.alias("piece")).agg(sorted_values.alias("rows"))


def _through(pieces: DataFrame, key: str, columns: list[str], start: Column, step) -> DataFrame:
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("piece", *columns))), start, step)
    return pieces.groupBy(key).agg(folded.alias("value"))


def clamped(rows: DataFrame, key: str, order: list[str], piece: Column, step: str, low: int, high: int, start: int) -> DataFrame:
    """Per key the end of a walk of integer steps that stays between low and high. A piece is x -> min(h, max(l, x + a))."""
    whole = lambda x: F.lit(x).cast("long")
    held = lambda x: F.least(whole(high), F.greatest(whole(low), x))
    first = F.struct(whole(-FAR).alias("l"), whole(FAR).alias("h"), whole(0).alias("a"))
    add = lambda s, r: F.struct(held(s["l"] + r["_v"]).alias("l"), held(s["h"] + r["_v"]).alias("h"), (s["a"] + r["_v"]).alias("a"))
    made = _pieces(rows.withColumn(step, F.col(step).cast("long")), key, order, piece, step).select(key, "piece", F.aggregate("rows", first, add).alias("f"))
    return _through(made.select(key, "piece", "f.*"), key, ["l", "h", "a"], whole(start), lambda x, p: F.least(p["h"], F.greatest(p["l"], x + p["a"])))


def smoothed(rows: DataFrame, key: str, order: list[str], piece: Column, value: str, share: float, start: float) -> DataFrame:
    """Per key the exponential average share * value + (1 - share) * before, from `start` on. A piece is x -> m * x + a."""
    first = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("a"))
    add = lambda s, r: F.struct((s["m"] * (1 - share)).alias("m"), (s["a"] * (1 - share) + share * r["_v"]).alias("a"))
    made = _pieces(rows, key, order, piece, value).select(key, "piece", F.aggregate("rows", first, add).alias("f"))
    return _through(made.select(key, "piece", "f.*"), key, ["m", "a"], F.lit(start), lambda x, p: p["m"] * x + p["a"])

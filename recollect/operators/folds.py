"""Operators whose result depends on an order, as folds over bounded groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import texts
from recollect.sources import staging


def pack_budget(rows: DataFrame, group: str, budget: int) -> DataFrame:
    """Per group, in order of hierarchy and score, takes what still fits the budget, and goes on after what doesn't. Columns: group, id,
    hierarchy, score, tokens; with `text`, what doesn't fit is cut to what is left, if it can be. A group is a result list, so it is
    bounded by its limit. Returns group, id, and the text that is kept."""
    cut = "text" in rows.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hierarchy", "score", "id"], ascending=[True, False, True])
        left, kept = budget, []
        for row in pdf.itertuples():
            text, need = (row.text if cut else None), row.tokens
            if need > left and cut:
                text = texts.compacted(row.text, left)
                need = texts.token_estimate(text) if text is not None else left + 1
            if need <= left:
                left -= need
                kept.append((getattr(row, group), row.id, text))
        return pd.DataFrame(kept, columns=[group, "id", "text"]).astype({"text": object})

    return rows.groupBy(group).applyInPandas(fold, f"{group} {dict(rows.dtypes)[group]}, id long, text string")


def promoted(pdf: pd.DataFrame, pool: int, head: int = 10, want: int = 3, share: float = 0.3) -> pd.DataFrame:
    """A result list, best first: sessions of the first `head` with fewer than `want` rows in the pool pull theirs from behind it, at most
    `share` of the pool, in place of its last rows. Columns: id, session_id."""
    inside, behind = pdf.iloc[:pool], pdf.iloc[pool:]
    pulled = []
    for session in dict.fromkeys(s for s in inside["session_id"].iloc[:head] if s is not None and s == s):
        missing = want - int((inside["session_id"] == session).sum())
        pulled += list(behind[behind["session_id"] == session].index[: max(0, missing)])
    pulled = pulled[: int(share * pool)]
    return pd.concat([inside.iloc[: pool - len(pulled)] if len(inside) == pool else inside, behind.loc[pulled]])


def promote_sessions(rows: DataFrame, group: str, pool: int = 75) -> DataFrame:
    """Per group (a result list, so bounded by its limit) the rows that promoted() keeps, with their rank. Columns: group, id, session_id,
    score."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = promoted(pdf.sort_values(["score", "id"], ascending=[False, True]), pool)
        return kept.assign(rank=range(1, len(kept) + 1))[[group, "id", "rank"]]

    return rows.groupBy(group).applyInPandas(fold, f"{group} {dict(rows.dtypes)[group]}, id long, rank long")


def visible(scopes: list[str]) -> Column:
    """Rows of some scopes or the general one, neither archived nor superseded, no artifacts, no logs. Columns: scope, archived,
    vault_path, status, node_type."""
    path = F.col("vault_path").isNull() | ~F.col("vault_path").contains("wiki/artifacts/")
    return F.col("scope").isin([*scopes, "general"]) & ~F.coalesce("archived", F.lit(False)) & path & (F.col("status") != "superseded") & ~F.col("node_type").isin("tool_execution", "system_log", "handoff_event")


def structured(rows: DataFrame, order: Column, concepts: list, files: list[str], limit: int) -> DataFrame:
    """The best 3 * limit rows, filtered by concepts and files; unfiltered if none passes; at most `limit`. Columns: concepts,
    files_read, files_modified."""
    best = rows.orderBy(order).limit(3 * limit)
    passes = F.arrays_overlap("concepts", F.array(*(F.lit(x) for x in concepts))) & F.arrays_overlap(F.concat("files_read", "files_modified"), F.array(*(F.lit(x) for x in files)))
    marked = best.withColumn("_pass", F.coalesce(passes, F.lit(False)))
    kept = marked.withColumn("_any", F.max("_pass").over(Window.partitionBy())).where("_pass OR NOT _any")  # 3 * limit rows at most
    return kept.orderBy(order).limit(limit).drop("_pass", "_any")


def first_of_each(rows: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key, numbered in `k`. Each task keeps only n a key, so a hot key costs no task all its rows."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= n)


# Characters of all patterns that a task holds as one trie, and places of a text that are looked at together.
MOST_IN_TRIE, BLOCK = 1 << 22, 1 << 20


def contained(rules: DataFrame, texts: DataFrame, pattern: str, text: str, width: int) -> DataFrame:
    """`rules` with `hits`, the number of texts that contain their pattern, where there are any. The patterns, whose characters are counted first, form a
    trie that each task passes its texts through, so the work is a text's length; with too many for that, the texts' pieces meet them in a join."""
    wanted = rules.select(F.col(pattern).alias("_piece")).where("_piece IS NOT NULL").distinct()
    size = wanted.agg(F.sum(F.length("_piece")), F.count("*")).first()
    if max(size[0] or 0, size[1]) > MOST_IN_TRIE:
        hits = _contained_by_join(wanted, texts, text)
    else:
        hits = _contained_by_trie([r[0] for r in wanted.collect()], texts, text)
    return rules.join(hits.withColumnRenamed("_piece", pattern), pattern)


def _contained_by_join(wanted: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(_piece, hits): pieces of each length that occurs."""
    hits = texts.sparkSession.createDataFrame([], "_piece string, hits long")
    for n in sorted(r[0] for r in wanted.select(F.length("_piece")).distinct().collect()):  # a few numbers
        cut = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(F.col(text), i, F.lit(n)))  # noqa: B023
        pieces = texts.where(F.length(text) >= n).select(F.explode(F.array_distinct(cut)).alias("_piece"))
        hits = hits.unionByName(pieces.join(wanted.where(F.length("_piece") == n), "_piece").groupBy("_piece").agg(F.count("*").alias("hits")))
    return hits


def _contained_by_trie(patterns: list[str], texts: DataFrame, text: str) -> DataFrame:
    """(_piece, hits). A node is a number, and a child is found by node * alphabet + character in a sorted array, for all places of a block at once."""
    alphabet = np.unique(np.frombuffer("".join(patterns).encode("utf-32-le"), np.uint32))
    wide, rank = len(alphabet), {chr(c): k for k, c in enumerate(alphabet)}
    child: dict[int, int] = {}
    ends = [-1]
    for k, p in enumerate(patterns):
        node = 0
        for x in p:
            node = child.setdefault(node * wide + rank[x], len(ends))
            if node == len(ends):
                ends.append(-1)
        ends[node] = k
    steps = np.array(sorted(child), np.int64)
    goes, ends = np.array([child[k] for k in steps.tolist()], np.int32), np.array(ends, np.int64)
    dense = len(ends) * wide <= 1 << 22  # a cell a node and character

    def children(node: np.ndarray, x: np.ndarray, table: np.ndarray | None) -> np.ndarray:
        key = node * wide + x
        if table is not None:
            return np.where(x >= 0, table[key], -1)
        k = np.minimum(np.searchsorted(steps, key), len(steps) - 1)
        return np.where((x >= 0) & (steps[k] == key), goes[k], -1)

    def met(rows: list[str], known: np.ndarray, table: np.ndarray | None) -> np.ndarray:
        """Numbers of the patterns in each of the rows, once a row."""
        codes = known[np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)]
        stops = np.cumsum([len(r) for r in rows])
        found = [np.arange(len(rows)) * len(patterns) + ends[0]] if ends[0] >= 0 else []
        for at in range(0, len(codes) if wide else 0, BLOCK):
            place = np.arange(at, min(at + BLOCK, len(codes)))
            row, node, deep = np.searchsorted(stops, place, "right"), np.zeros(len(place), np.int64), 0
            while len(place):
                inside = place + deep < stops[row]
                place, row, node = place[inside], row[inside], node[inside]
                node = children(node, codes[place + deep], table)
                goes_on = node >= 0
                place, row, node, deep = place[goes_on], row[goes_on], node[goes_on].astype(np.int64), deep + 1
                here = ends[node] >= 0
                found.append(row[here] * len(patterns) + ends[node[here]])
            found = [np.unique(np.concatenate(found))] if found else []
        return (found[0] if found else np.zeros(0, np.int64)) % len(patterns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.full(0x110000, -1, np.int32)
        known[alphabet] = np.arange(wide)
        table = None
        if dense:
            table = np.full(len(ends) * wide, -1, np.int32)
            table[steps] = goes
        total = np.zeros(len(patterns), np.int64)
        for batch in batches:
            if batch.num_rows and patterns:
                total += np.bincount(met(batch.column(0).to_pylist(), known, table), minlength=len(patterns))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([patterns[k] for k in some], pa.string()), pa.array(total[some])], names=["_piece", "hits"])

    return texts.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "_piece string, hits long").groupBy("_piece").agg(F.sum("hits").alias("hits"))


def all_parts(items: DataFrame, key: str, parts: str, docs: DataFrame, text: str, most: int = 1 << 20) -> DataFrame:
    """Per item the number of texts that contain all its parts. The longest word that stands whole inside a part is looked up among the
    texts' words, which leaves few texts to search. Items without such a word are compared with every text."""
    inside = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"(?<=[^\p{L}\p{N}])[\p{L}\p{N}]+(?=[^\p{L}\p{N}])"), F.lit(0))))
    longest = F.element_at(F.array_sort(inside, lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)), -1)
    asked = staging.staged(items.select(key, parts, F.when(F.size(inside) > 0, longest).alias("_word")), "items")
    numbered = docs.select(text).withColumn("_row", F.monotonically_increasing_id())
    rows = staging.staged(numbered, "texts")
    words = rows.select("_row", F.explode(F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+"))).alias("_word"))
    wanted = asked.where("_word IS NOT NULL").select("_word", key)
    met = words.join(F.broadcast(wanted) if wanted.count() <= most else wanted, "_word").select("_row", key)
    found = met.join(rows, "_row").join(asked.select(key, parts), key).where(F.forall(parts, lambda p: F.contains(F.col(text), p))).groupBy(key).agg(F.count("*").alias("hits"))
    rest = asked.where("_word IS NULL").select(key, parts)
    slow = rows.join(F.broadcast(rest), F.forall(parts, lambda p: F.contains(F.col(text), p))).groupBy(key).agg(F.count("*").alias("hits"))
    return items.select(key).join(found.unionByName(slow), key, "left").select(key, F.coalesce("hits", F.lit(0)).alias("hits"))


def diverse(pool: DataFrame, key: str, n: int, share: float) -> DataFrame:
    """The first n rows by maximal marginal relevance: share * sim less (1 - share) times the greatest product with a row chosen before.
    pool: key, embedding, sim; a result list, so bounded by its limit."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sim", key], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf["embedding"].to_numpy()).astype(float)
        worst, chosen = np.zeros(len(pdf)), []
        for _ in range(min(n, len(pdf))):
            gain = np.round(share * pdf["sim"].to_numpy() - (1 - share) * worst, 9)
            gain[chosen] = -np.inf
            best = int(np.argmax(gain))
            chosen.append(best)
            worst = np.maximum(worst, v @ v[best]) if len(chosen) > 1 else v @ v[best]
        return pd.DataFrame({key: pdf[key].to_numpy()[chosen], "place": range(1, len(chosen) + 1)})

    return pool.groupBy().applyInPandas(fold, f"{key} long, place int")

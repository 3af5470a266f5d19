"""Quality by a sparse rule ensemble.

Statistics of each text are computed once, over whole texts. Small trees are grown on a bounded sample of labelled rows; each
path from a root to a node is a rule, a conjunction of comparisons. A logistic model with an L1 penalty keeps a few rules, and
these are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common
from recollect.llm.toxicity import FOLD, fold, sample

SAMPLE, THRESHOLD, TREES, DEPTH, BINS = 20_000, 0.7, 40, 3, 24

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "stops": b".?;:",
    "commas": b",",
    "shouts": b"!",
    "bars": b"|",
    "symbols": b"#$%&*@^~<>{}[]=+_\\/",
    "newlines": b"\n",
}
STATS = ["log_words", "word_bytes", "distinct", "repeats", "top", "words_a_line", "words_a_stop", *(f"{c}_share" for c in CLASSES)]
_LUT = {c: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for c, v in CLASSES.items()}


def text_stats(batch: pa.RecordBatch) -> np.ndarray:
    """A row of STATS a text (column 1); zeros without words."""
    found = common.Words(batch.column(1))
    n = found.count().astype(float)
    size = np.maximum(1, np.diff(found.offsets)).astype(float)
    counts = {}
    for c, lut in _LUT.items():
        total = np.concatenate(([0], np.cumsum(lut[found.data], dtype=np.int64)))
        counts[c] = (total[found.offsets[1:]] - total[found.offsets[:-1]]).astype(float)
    letters = np.concatenate(([0], np.cumsum(found.end - found.start, dtype=np.int64)))
    word_bytes = (letters[found.first[1:]] - letters[found.first[:-1]]) / np.maximum(1, n)
    distinct, repeats, top = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i in range(len(n)):
        h = found.of(i)
        if len(h):
            order = np.sort(h)
            edges = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True])))
            distinct[i] = (len(edges) - 1) / len(h)
            top[i] = np.diff(edges).max() / len(h)
            repeats[i] = np.count_nonzero(h[1:] == h[:-1]) / len(h)
    some = n > 0
    cols = [np.log1p(n), word_bytes, distinct, repeats, top, n / (counts["newlines"] + 1), n / (counts["stops"] + 1), *(counts[c] / size for c in CLASSES)]
    return np.column_stack(cols) * some[:, None]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row."""

    def run(batches):
        for whole in batches:
            for batch in common.chunks(whole):
                made = text_stats(batch)
                yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(made[:, k])) for k in range(len(STATS)))], names=["doc_id", *STATS])

    return common.ids_and_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, over?, bound), all of which hold


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as a column expression over STATS."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, over, bound in rule:
                c = F.col(STATS[k])
                holds = holds & (c > bound if over else c <= bound)
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, over, bound in rule:
        out &= x[:, k] > bound if over else x[:, k] <= bound
    return out


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, path: Rule = ()) -> list[Rule]:
    """Rules of a tree of DEPTH levels with the least Gini impurity among some statistics a node."""
    if len(path) == DEPTH or len(y) < 20 or y.min() == y.max():
        return []
    best, found = 1e-9, None
    base = len(y) * y.mean() * (1 - y.mean())
    for k in rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]:
        at = np.searchsorted(cuts[k], x[:, k])  # values above cuts[k][j] have at > j
        n = np.bincount(at, minlength=len(cuts[k]) + 1).cumsum()[:-1]
        s = np.bincount(at, y, minlength=len(cuts[k]) + 1).cumsum()[:-1]
        m, t = len(y) - n, y.sum() - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = base - np.where(n > 0, s * (1 - s / n), 0) - np.where(m > 0, t * (1 - t / m), 0)
        gain[(n < 5) | (m < 5)] = 0
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (int(k), float(cuts[k][gain.argmax()]))
    if found is None:
        return []
    k, bound = found
    low = x[:, k] <= bound
    under, over = (*path, (k, False, bound)), (*path, (k, True, bound))
    return [under, over, *grow(x[low], y[low], cuts, rng, under), *grow(x[~low], y[~low], cuts, rng, over)]


def lasso(z: np.ndarray, y: np.ndarray, strength: float, start: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic weights (the first is the free intercept) with an L1 penalty, by accelerated proximal steps."""
    n = len(y)
    size = 4 * n / max(1e-9, np.linalg.norm(z, 2) ** 2)
    w = v = start
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v)))
        new = v - size * (z.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - size * strength)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t, move = new + (t - 1) / after * (new - w), new, after, abs(new - w).max()
        if move < 1e-5:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Ensemble:
    """Rules and weights; the penalty is the one with the least loss on a fifth of the sample. With one label only, or too few
    rows, a constant."""
    if len(y) < 20 or y.min() == y.max():
        mean = (float(y.sum()) + 1) / (len(y) + 2)
        return Ensemble([], [], float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])]
    cuts = [np.unique(np.concatenate((c, np.quantile(x[:, k], [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998])))) for k, c in enumerate(cuts)]
    found: dict[bytes, Rule] = {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        for rule in grow(x[rows], y[rows], cuts, rng):
            holds = applies(rule, x)
            if 5 <= holds.sum() <= len(y) - 5:
                found.setdefault(np.packbits(holds).tobytes(), rule)  # one rule of those that say the same
    rules = sorted(found.values())
    if not rules:
        return fit(x[:0], y)
    z = np.column_stack([np.ones(len(y)), *(applies(r, x).astype(float) for r in rules)])
    test = rng.random(len(y)) < 0.2
    best, chosen, w = np.inf, 1e-2, np.zeros(z.shape[1])
    for strength in (3e-2, 1e-2, 3e-3, 1e-3, 3e-4):
        w = lasso(z[~test], y[~test], strength, w)
        p = np.clip(1 / (1 + np.exp(-(z[test] @ w))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)) if test.any() else 0
        if loss < best - 1e-4:
            best, chosen = loss, strength
    w = lasso(z, y, chosen, np.zeros(z.shape[1]), 600)
    kept = [i for i in range(len(rules)) if abs(w[i + 1]) > 1e-6]
    return Ensemble([rules[i] for i in kept], [float(w[i + 1]) for i in kept], float(w[0]))


def train(stats: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Ensemble:
    rows = stats.join(F.broadcast(sample(stats, labels, "quality", most)), "doc_id").select("doc_id", "label", *STATS).toArrow().sort_by([("doc_id", "ascending")])
    x = np.column_stack([rows.column(s).to_numpy() for s in STATS]) if rows.num_rows else np.zeros((0, len(STATS)))
    return fit(x, rows.column("label").to_numpy().astype(float))


def scored(stats: DataFrame, model: Ensemble, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (null id: false), score, predicted."""
    held = F.coalesce(fold(F.col("doc_id")) == FOLD, F.lit(False)).alias("held_out")
    out = stats.select("doc_id", held, model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows. Null and empty texts have zero statistics; repeated rows score alike; a null doc_id is in no fold and
    trains nothing; an empty table gives no rows, and without labels all score alike. Very long texts are counted whole; other columns
    of `docs` aren't read."""
    stats = common.staged(spark, statistics(docs), "statistics")
    return scored(stats, train(stats, labels))

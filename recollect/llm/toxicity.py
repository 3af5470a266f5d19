"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to symbols: insult (with a level) or threat, target, negation, report, quote, clause end, other. Three
transducers follow, each reading what the one before writes:

  negation  writes an insult or a threat within a few words of a negation as a negated one;
  speech    writes what stands behind a verb of saying or a quotation mark, in the same clause, as a reported one;
  aim       writes readings: an insult as plain or, behind a target, as aimed; a threat only once its target has come.

`then` composes two transducers into one, and `compiled` makes a table of the whole chain. Arcs that write a reading have its
weight, an insult's arc times its level. A text's score adds up the log of the matches in each reading, by weight, in a
logistic function; a word outside a matched clause counts for nothing.

The lexicon holds a few fixed English words. Others, whole words or stems in any language, and all weights are learned from a
bounded sample of labelled rows (SAMPLE rows and SAMPLE_BYTES bytes at most): a form is taken if its share of toxic documents
can't be chance, given all forms tried, with at most three occurrences a document counted. `ablation` shows what each reading
adds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common

SAMPLE, SAMPLE_BYTES, THRESHOLD, FOLD = 6_000, 64 << 20, 0.3, 2
MEMO = 200_000  # words whose symbol a task remembers at once
OUT = "doc_id long, held_out boolean, score double, predicted int"
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”„«»]")

# Words of the grammar.
INSULTS = "idiot moron stupid dumb loser clown scum trash pathetic worthless disgusting imbecile fool coward pig vermin parasite bastard".split()
THREATS = "kill hurt destroy beat stab shoot strangle murder".split()
TARGETS = "you your yours u ur he she they them him her his their du ihr euch dich sie tu vous toi usted ustedes".split()
NEGATIONS = "not no never nobody isn aren wasn weren don doesn didn cannot nicht kein keine nie pas jamais ni nunca".split()
REPORTS = "said says saying claimed claims wrote writes called calls quoted quote reported reports alleged sagte sagt dit disait dijo dice".split()

OTHER, TARGET, NEGATION, REPORT, QUOTE, END, THREAT, INSULT = range(8)  # what the lexicon writes
NEGATED_THREAT, NEGATED_INSULT, TOLD_THREAT, TOLD_INSULT = range(8, 12)  # what the middle of the chain writes besides
LEVELS = 8  # an insult's symbol is INSULT + its level
WINDOW = 3  # words that a negation reaches
READINGS = ("plain", "aimed", "negated", "reported", "threat", "threat_off")
PLAIN, AIMED, NEGATED, TOLD, MENACE, MENACE_OFF = range(6)
NOTHING = -1


class Transducer:
    """step(state, symbol) -> (next state, symbol written); it starts in state `start`, and anew behind a clause's end."""

    def __init__(self, step, start=0):
        self.step, self.start = step, start

    def read(self, symbols: list[int]) -> list[int]:
        state, out = self.start, []
        for x in symbols:
            state, y = self.step(state, x)
            out.append(y)
        return out


def then(a: Transducer, b: Transducer) -> Transducer:
    """The composition: b reads what a writes."""

    def step(state, x):
        p, y = a.step(state[0], x)
        q, z = b.step(state[1], y)
        return (p, q), z

    return Transducer(step, (a.start, b.start))


def _negation(left: int, x: int) -> tuple[int, int]:
    if x in (NEGATION, END):
        return (WINDOW if x == NEGATION else 0), (OTHER if x == NEGATION else END)
    return max(0, left - 1), {INSULT: NEGATED_INSULT, THREAT: NEGATED_THREAT}.get(x, x) if left else x


def _speech(told: int, x: int) -> tuple[int, int]:
    if x in (REPORT, QUOTE):
        return 1, OTHER
    return (0 if x == END else told), {INSULT: TOLD_INSULT, THREAT: TOLD_THREAT}.get(x, x) if told else x


def _aim(state: tuple[int, int], x: int) -> tuple[tuple[int, int], int]:
    seen, pending = state  # a target; a threat without one yet (1), or one that doesn't count (2)
    if x == END:
        return (0, 0), NOTHING
    if x == TARGET:
        return (1, 0), (NOTHING, MENACE, MENACE_OFF)[pending]
    if x in (THREAT, NEGATED_THREAT, TOLD_THREAT):
        return (seen, 1 if x == THREAT else 2), NOTHING
    return state, {INSULT: AIMED if seen else PLAIN, NEGATED_INSULT: NEGATED, TOLD_INSULT: TOLD}.get(x, NOTHING)


negation, speech, aim = Transducer(_negation), Transducer(_speech), Transducer(_aim, (0, 0))


def compiled(t: Transducer, symbols: int = INSULT + 1) -> tuple[list[list[int]], list[list[int]]]:
    """next[state][symbol] and written[state][symbol] of the states that can be reached; state 0 is the start."""
    number, todo, nxt, out = {t.start: 0}, [t.start], [], []
    while todo:
        state = todo.pop(0)
        row = [t.step(state, x) for x in range(symbols)]
        for after, _ in row:
            if after not in number:
                number[after] = len(number)
                todo.append(after)
        nxt.append([number[after] for after, _ in row])
        out.append([y for _, y in row])
    return nxt, out


NEXT, EMIT = compiled(then(then(negation, speech), aim))


@dataclass
class Grammar:
    """words and stems: form -> level of an insult (1 to LEVELS); weights: of the readings, the first is the intercept."""

    words: dict[str, int] = field(default_factory=lambda: dict.fromkeys(INSULTS, 5))
    stems: dict[str, int] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-3.0, 3.0, 3.5, 0.5, 0.5, 3.5, 0.5])

    def symbol(self, word: str) -> int:
        level = self.words.get(word, 0)
        for k in range(4, min(len(word), 8)):
            level = max(level, self.stems.get(word[:k], 0))
        if level:
            return INSULT + level - 1
        for symbol, found in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in found:
                return symbol
        return OTHER if word[0].isalpha() else END if word in ".!?;\n" else QUOTE

    def features(self, texts: list[str], memo: dict[str, int]) -> np.ndarray:
        """Per text, log(1 + summed weight) of the matches in each reading."""
        out = np.zeros((len(texts), len(READINGS)))
        for i, text in enumerate(texts):
            tokens = TOKEN.findall(text.lower())
            for token in set(tokens).difference(memo):
                memo[token] = self.symbol(token)
            codes = bytes(map(memo.__getitem__, tokens))
            if not codes or max(codes) < THREAT:
                continue
            for clause in codes.split(bytes([END])):
                if not clause or max(clause) < THREAT:
                    continue
                state = 0
                for code in clause:
                    c = min(code, INSULT)
                    reading = EMIT[state][c]
                    if reading >= 0:
                        out[i, reading] += (code - INSULT + 1) / 4 if c == INSULT else 1.0
                    state = NEXT[state][c]
        return np.log1p(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + features @ np.array(self.weights[1:]))))


def forms(text: str) -> Counter[str]:
    """How often each whole word (with a closing mark) and each stem of 4 to 7 letters occurs."""
    out: Counter[str] = Counter()
    for w, n in Counter(re.findall(r"[^\W\d_]+", text.lower())).items():
        if len(w) > 2:
            out[w + "$"] += n
        for k in range(4, min(len(w), 8)):
            out[w[:k]] += n
    return out


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of the columns of x, drawn towards `prior`."""
    w = prior.copy() if start is None else start
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * (w - prior))
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-7:
            break
    return w


def lexicon(texts: list[str], y: np.ndarray) -> dict[str, int]:
    """Forms and levels. Form by form, the one goes in that best explains what those before leave unexplained (a score test),
    as long as that can't be chance given all forms tried. So a word that only comes along in copies of a toxic text stays out."""
    rate = y.mean()
    tried: Counter[str] = Counter()
    for t, toxic in zip(texts, y, strict=True):
        if toxic:
            tried.update(forms(t).keys())
    bar = math.log(100 * max(1, len(tried)))
    names = sorted(f for f, n in tried.items() if n * math.log(1 / rate) > bar / 2)
    number = {f: i for i, f in enumerate(names)}
    del tried
    doc, form, times = [], [], []
    for i, t in enumerate(texts):
        hits = [(number[f], n) for f, n in forms(t).items() if f in number]
        doc.append(np.full(len(hits), i, np.int32))
        form.append(np.array([f for f, _ in hits], np.int32))
        times.append(np.minimum([n for _, n in hits], 3).astype(np.float32))
    doc, form, times = np.concatenate(doc), np.concatenate(form).astype(np.int64), np.concatenate(times).astype(np.float64)
    m = len(names)
    a, n = np.bincount(form, y[doc], m), np.bincount(form, minlength=m)
    odds = (a + 0.5) / (n - a + 0.5) * (1 - rate) / rate
    length = np.array([len(f) + 10 * f.endswith("$") for f in names])
    free, total, chosen = odds > 1.5, np.zeros(len(texts)), {}
    while free.any():
        x = np.column_stack([np.ones(len(texts)), np.log1p(total)])
        w = logistic(x, y, np.zeros(2), np.array([1e-3, 1e-2]))
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g, h = np.bincount(form, (y - p)[doc] * times, m), np.bincount(form, (p * (1 - p))[doc] * times**2, m) + 0.25
        gain = np.where(free & (g > 0), g * g / h / 2, 0)
        best = max(np.flatnonzero(gain > gain.max() * 0.999), key=lambda i: (length[i], -i))  # of those that match alike, the longest
        if gain[best] <= bar:
            break
        stem = names[best].rstrip("$")
        chosen[names[best]] = level = max(1, min(LEVELS, round(math.log(odds[best]))))
        mine = form == best
        total += np.bincount(doc[mine], times[mine] * level / 4, len(texts))
        if names[best].endswith("$"):  # covers itself, and stems met in this word alone
            free &= np.array([not (i == best or stem.startswith(f) and len(f) < len(stem) and n[i] == n[best]) for i, f in enumerate(names)])
        else:  # covers longer words and stems, not the word of just these letters
            free &= np.array([not (f.startswith(stem) and f != stem + "$") for f in names])
    return chosen


def learn(texts: list[str], labels: list[int]) -> Grammar:
    """Lexicon and weights from a sample; equal texts count once. Without both labels in it the fixed grammar stays."""
    once = dict(zip(texts, labels, strict=True))
    texts, y = list(once), np.array(list(once.values()), float)
    grammar = Grammar()
    if not len(y) or y.min() == y.max():
        return grammar
    for f, level in lexicon(texts, y).items():
        (grammar.words if f.endswith("$") else grammar.stems)[f.rstrip("$")] = level
    x = np.hstack([np.ones((len(texts), 1)), grammar.features(texts, {})])
    prior = np.array(Grammar().weights)
    grammar.weights = logistic(x, y, prior, np.array([1e-3] + [1.0] * len(READINGS))).tolist()
    return grammar


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, name: str, most: int = SAMPLE, held_out: int = FOLD) -> DataFrame:
    """At most `most` training rows (doc_id, label), the same whatever their order: by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    chosen = known.where(fold(F.col("doc_id")) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def ablation(texts: list[str], labels: list[int], grammar: Grammar) -> dict[str, float]:
    """How well scores rank the texts (share of pairs of a toxic and another text in the right order), with all readings ("") and
    without each."""
    x, y = grammar.features(texts, {}), np.array(labels, bool)
    out = {}
    for k, name in enumerate(("", *READINGS)):
        left = x.copy()
        if k:
            left[:, k - 1] = 0
        s = np.round(grammar.score(left), 12)
        bad, fine = s[y], np.sort(s[~y])
        below, upto = np.searchsorted(fine, bad, "left"), np.searchsorted(fine, bad, "right")
        out[name] = float((below + upto).sum() / 2 / max(1, len(bad) * len(fine)))
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Grammar:
    """Learns from at most `most` rows and `most_bytes` bytes of training rows, in the order of a hash of the id; a text of over an eighth of these
    bytes isn't learned from. Null texts are empty; without labels the fixed grammar holds."""
    known = common.ids_and_text(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 8)
    chosen = known.join(F.broadcast(sample(docs, labels, "toxic", most)), "doc_id")
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in chosen.select("doc_id", F.xxhash64("doc_id").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect())  # `most` ids and repeats of them
    total = np.cumsum([n for *_, n in sizes]) if sizes else np.zeros(0)
    cut = int(np.searchsorted(total, most_bytes, "right"))
    bar = sizes[cut][0] if cut < len(sizes) else None  # the first row that is too much
    rows = (chosen if bar is None else chosen.where(F.xxhash64("doc_id") < bar)).select("doc_id", "text", "label").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    return learn([t or "" for t in rows.column("text").to_pylist()], rows.column("label").to_pylist())


def scored(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (its fold is the held-out one; null id: false), score, predicted. Null and empty texts match nothing; repeated rows are
    scored one by one; very long texts are read whole."""

    def run(batches):
        memo: dict[str, int] = {}
        for whole in batches:
            for batch in common.chunks(whole):
                if len(memo) > MEMO:
                    memo.clear()
                p = grammar.score(grammar.features([t or "" for t in batch.column(1).to_pylist()], memo))
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col("doc_id")) == FOLD, F.lit(False)).alias("held_out")
    return common.ids_and_text(docs).select("doc_id", "text", held).mapInArrow(run, OUT)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows by a grammar learned from the training folds' labels. A table without rows gives none."""
    return scored(docs, fit(docs, labels))


def passing(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs`, all columns, whatever their names, whose own text scores under the threshold. Null and empty texts match nothing
    and stay; a null doc_id doesn't matter; repeated rows are judged one by one; very long texts are read whole."""
    common.small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches):
        memo: dict[str, int] = {}
        at = schema.fieldNames().index("text")
        for whole in batches:
            for batch in common.chunks(whole, text=at):
                if len(memo) > MEMO:
                    memo.clear()
                p = grammar.score(grammar.features([t or "" for t in batch.column(at).to_pylist()], memo))
                yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, schema)

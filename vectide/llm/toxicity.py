"""Toxicity by class-conditional Kneser-Ney models of expressions.

Each class has a Kneser-Ney model of how its words are spelt: the highest order has counts of the class, all lower orders
are continuation counts that both classes share. So a rare expression that a class hasn't seen falls back to the same
estimate in both, and only discounts differ. A text's toxic and ordinary log-likelihoods are compared word by word and
divided by its number of distinct words: as a mean, as a mean of what is clearly toxic, as a mixture of both classes, and
for its most toxic words. Logistic regression puts these on one scale: it is fitted to a sample of training rows, by models that
haven't seen them. Then the models are built anew from all training rows, expressions of a single text included.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

LETTERS = re.compile(r"[^\W\d_]+")
ORDER = 6  # characters of a gram
DISCOUNT = 0.75
TUNE = 4  # one labelled row in so many may fit the scale
SCALE_ROWS = 5_000  # labelled rows that fit the scale, at most
LONGEST = 40  # longest word whose ratio is kept; longer runs of letters are rated in stretches of so many grams
CLEAR = 1.0  # log-likelihood ratio from which a word counts as clearly toxic
TOP = 3  # most toxic words that are looked at by themselves


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased runs of letters."""
    return set(LETTERS.findall(text.lower())) if text else set()


def grams(word: str) -> list[str]:
    padded = "^" * (ORDER - 1) + word + "$"
    return [padded[k : k + ORDER] for k in range(len(padded) - ORDER + 1)]


@dataclass
class Model:
    """Log-likelihood ratio of a gram; of one that no class has seen, by its context. Then the scale."""

    gram: dict[str, float] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(4))
    offset: float = -20.0

    def ratio(self, word: str) -> float:
        return sum(self._of_grams(word))

    def stretches(self, word: str) -> list[float]:
        """Ratios of the stretches of a run of letters without spaces. Each of its grams is in one of them."""
        each = self._of_grams(word)
        return [sum(each[k : k + LONGEST]) for k in range(0, len(each), LONGEST)]

    def _of_grams(self, word: str) -> list[float]:
        return [self.gram[g] if g in self.gram else self.context.get(g[:-1], 0.0) for g in grams(word)]

    def score(self, features: np.ndarray) -> float:
        return 1 / (1 + exp(-max(-30.0, min(30.0, float((features * self.slopes).sum()) + self.offset))))


def fit_models(counts: dict[str, tuple[int, int]]) -> Model:
    """From words and how many ordinary and toxic texts have them."""
    own = [Counter(), Counter()]
    for word, by_class in counts.items():
        for g in grams(word):
            for c in (0, 1):
                if by_class[c]:
                    own[c][g] += by_class[c]
    return fit_grams(own)


def fit_grams(own: list[Counter]) -> Model:
    """From the grams of the words of ordinary and of toxic texts, with their numbers."""
    if not own[0] or not own[1]:
        return Model()
    shared = _shared_backoff(own[0].keys() | own[1].keys())
    totals = [_totals(x) for x in own]

    def probability(c: int, g: str) -> float:
        n, kinds = totals[c].get(g[:-1], (0, 0))
        if not n:
            return shared(g[1:])
        return max(own[c].get(g, 0) - DISCOUNT, 0) / n + DISCOUNT * kinds / n * shared(g[1:])

    def left_over(c: int, context: str) -> float:
        n, kinds = totals[c].get(context, (0, 0))
        return DISCOUNT * kinds / n if n else 1.0

    seen = own[0].keys() | own[1].keys()
    contexts = totals[0].keys() | totals[1].keys()
    return Model({g: log(probability(1, g)) - log(probability(0, g)) for g in seen}, {x: log(left_over(1, x)) - log(left_over(0, x)) for x in contexts})


def _totals(own: Counter) -> dict[str, tuple[int, int]]:
    """Of each context: how often it stands, and before how many characters."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for g, n in own.items():
        x = out[g[:-1]]
        x[0] += n
        x[1] += 1
    return {k: (a, b) for k, (a, b) in out.items()}


def _shared_backoff(seen):
    """Interpolated probability of a shorter gram's last character, from continuation counts of both classes together."""
    level, tables = set(seen), []
    while len(next(iter(level))) > 1:
        follow: Counter = Counter(g[1:] for g in level)  # in how many ways each shorter gram is continued to the left
        tables.append((follow, _totals(follow)))
        level = set(follow)
    alphabet = 1 / (len(level) + 1)

    def probability(g: str, depth: int = 0) -> float:
        if depth == len(tables):
            return alphabet
        follow, totals = tables[depth]
        n, kinds = totals.get(g[:-1], (0, 0))
        if not n:
            return probability(g[1:], depth + 1)
        return max(follow.get(g, 0) - DISCOUNT, 0) / n + DISCOUNT * kinds / n * probability(g[1:], depth + 1)

    return probability


def fit_scale(features: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic regression with a weak ridge, by Newton's method."""
    if not len(toxic) or toxic.min() == toxic.max():
        return np.zeros(4), 20.0 if len(toxic) and toxic.max() else -20.0
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.concatenate([(features - mean) / spread, np.ones((len(toxic), 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] / spread * mean).sum())


def features_of(ratios: np.ndarray) -> np.ndarray:
    """Of the log-likelihood ratios of a text's distinct words."""
    if not len(ratios):
        ratios = np.zeros(1)
    return np.array([ratios.mean(), np.maximum(ratios - CLEAR, 0).mean(), np.log(np.exp(np.minimum(ratios, 6.0)).mean()), np.sort(ratios)[-TOP:].mean()])


class _Scorer:
    """Features of texts; ratios of words are kept until there are too many."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def features(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if len(self.known) > 300_000:
            self.known.clear()
        ratios = []
        for w in words:
            if len(w) > LONGEST:
                ratios += self.model.stretches(w)
                continue
            if w not in self.known:
                self.known[w] = self.model.ratio(w)
            ratios.append(self.known[w])
        # sorted, so that sums don't depend on the order of a set
        return features_of(np.sort(np.array(ratios, float)))


def count_grams(known: DataFrame) -> DataFrame:
    """(g, o0, o1, t0, t1): how often ordinary and toxic texts have each gram, once for each of a text's distinct words; o in rows
    that don't fit the scale, t in those that do. From (text, toxic, tune); every row and every gram counts.
    """
    names = ["g", "o0", "o1", "t0", "t1"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [Counter() for _ in range(4)]
            for text, toxic, tune in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n[toxic + 2 * tune].update(words_of(text))
            own = [Counter() for _ in range(4)]
            for x, words in zip(own, n, strict=True):
                for w, times in words.items():
                    for g in grams(w):
                        x[g] += times
            every = list(set().union(*own))
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([x[g] for g in every], pa.int64()) for x in own]], names=names)

    counted = known.select("text", "toxic", "tune").mapInArrow(spell, "g string, o0 long, o1 long, t0 long, t1 long")
    return counted.groupBy("g").agg(*[F.sum(x).alias(x) for x in names[1:]])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale_rows: int = SCALE_ROWS) -> Model:
    """Learn from all labelled rows whose crc32(id as text) mod 5 is not 0.

    At most scale_rows of them, in order of a hash of the id, fit the scale. Distinct grams, not rows or words, are what the driver holds.
    Labels other than 0 and 1, null labels and null ids don't count; of several labels of an id the larger does. Null and empty texts have no
    words; rows that repeat an id all count; very long texts count as a whole. Empty tables give a model that calls nothing toxic. Other
    columns are ignored.
    """
    ids = F.col("doc_id")
    own = labels.where(F.col("toxic").isin(0, 1) & ids.isNotNull() & (F.crc32(ids.cast("string").cast("binary")) % 5 != 0))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    tune = own.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(TUNE)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(scale_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # labels grow with the documents, so they aren't broadcast; the tuning rows are at most scale_rows rows of two numbers
    marked = own.join(F.broadcast(tune.select("doc_id", F.lit(True).alias("tune"))), "doc_id", "left").withColumn("tune", F.coalesce("tune", F.lit(False)))
    known = texts.where(F.crc32(ids.cast("string").cast("binary")) % 5 != 0).join(marked.hint("merge"), "doc_id")
    fitting, both = [Counter(), Counter()], [Counter(), Counter()]
    for r in count_grams(known).toLocalIterator():
        for c in (0, 1):
            if r[1 + c]:
                fitting[c][r[0]] = r[1 + c]
            if r[1 + c] + r[3 + c]:
                both[c][r[0]] = r[1 + c] + r[3 + c]
    sent = docs.sparkSession.sparkContext.broadcast(fit_grams(fitting))
    del fitting

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["m", "toxic"])

    tuned = texts.join(F.broadcast(tune), "doc_id").select("text", "toxic").mapInArrow(means, "m array<double>, toxic int").collect()  # scale_rows rows
    sent.destroy()
    rows = sorted((r["m"], r["toxic"]) for r in tuned)
    model = fit_grams(both)
    model.slopes, model.offset = fit_scale(np.array([m for m, _ in rows]).reshape(-1, 4), np.array([t for _, t in rows], dtype=float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    held_out: crc32(id as text) mod 5 is 0; null if the id is null. All letters of a text count; a run of more than LONGEST of
    them, as in scripts without spaces, is rated in stretches. A null text counts as empty; an empty text scores
    like one whose words are as likely in both classes. Without labelled rows of both classes the score is near 0 (or 1, if all are toxic). Rows that repeat
    an id come back one by one. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for ids, texts in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([model_score(scorer, t) for t in texts], pa.float64())], names=["id", "score"])

    def model_score(scorer: _Scorer, text: str | None) -> float:
        return scorer.model.score(scorer.features(text))

    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scored = two.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Toxicity classifier, regularised by counterfactual sentences.

A logistic model over the words of a text and over the beginnings of words, so
that endings do not hide a stem.  Where a labelled sentence names a
group, copies of the text with that term swapped for the other terms of its set
are made, and the fit penalises the squared change of the score, so a neutral
mention of a group cannot raise it.  An L1 penalty leaves only telling words,
hence a long harmless text does not gather noise.

The fit uses a bounded, documented number of labelled rows and runs in one task
(its memory follows that bound); scoring covers every row and text.

Defined cases: null and empty texts score as the bias alone; rows are judged one
by one, so repeated rows get equal scores; without labelled rows of both kinds
the model is the smoothed base rate; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tranche.llm import common as C

# Interchangeable identity terms, one set a line.
IDENTITY_SETS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("immigrants", "refugees", "citizens"),
    ("disabled", "blind", "deaf"), ("young", "old"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"),
)


@dataclass(frozen=True)
class Settings:
    train_rows: int = 10_000       # labelled rows fitted on, by hash of the id
    min_texts: int = 4             # a feature of the model occurs in so many of them
    max_features: int = 20_000     # bound: those most strongly associated with either label
    cache: int = 150_000           # words a worker remembers at most
    l1: float = 1e-4
    fairness: float = 2.0          # weight of the squared change of a score under a swap
    steps: int = 200
    threshold: float = 0.7


def words_of(text: str) -> set[str]:
    return set(C.LETTERS.findall(text.lower()))


def features_of(words) -> set[str]:
    """Whole words (marked by a space) and beginnings of 3 to 8 letters."""
    return {w + " " for w in words} | {w[:k] for w in words for k in range(3, min(len(w), 8) + 1)}


def swaps(words: set[str], sets=IDENTITY_SETS) -> list[set[str]]:
    """The counterfactual copies of a text's words: each identity term swapped for each other of its set."""
    out = []
    for group in sets:
        for term in group:
            if term in words:
                out += [(words - {term}) | {other} for other in group if other not in words]
    return out


class Rows:
    """A 0/1 matrix by its positions, with products by a vector."""

    def __init__(self, rows: list[list[int]], width: int):
        self.width, self.n = width, len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), np.int64, len(self.row))

    def dot(self, w):
        return np.bincount(self.row, w[self.col], self.n) if self.n else np.zeros(0)

    def back(self, r):
        return np.bincount(self.col, r[self.row], self.width) if self.n else np.zeros(self.width)


def fit_rows(texts: list, labels: list[int], s: Settings, sets=IDENTITY_SETS) -> dict:
    """Proximal gradient descent with momentum on logistic loss + fairness + L1; a text is its distinct words."""
    y = np.array(labels, float)
    rate = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate / (1 - rate)))
    if len(set(labels)) < 2:
        return {"bias": bias, "weights": {}}
    # A first pass counts features in a fixed number of slots, so that those in too few texts are never held.
    mask = (1 << 22) - 1
    slots = np.zeros(mask + 1, np.int32)
    for t in texts:
        f = features_of(t)
        slots[np.unique(np.fromiter(map(hash, f), np.int64, len(f)) & mask)] += 1
    names: dict[str, int] = {}                    # features by a number
    brings: dict[str, tuple] = {}                 # features of every word

    def numbers(words) -> list[int]:
        for w in words:
            if w not in brings:
                brings[w] = tuple(names.setdefault(f, len(names)) for f in sorted(features_of({w}))
                                  if slots[hash(f) & mask] >= s.min_texts)
        return sorted({f for w in words for f in brings[w]})

    rows = [np.array(numbers(t), np.int32) for t in texts]
    swapped = [(i, np.array(numbers(c), np.int32)) for i, t in enumerate(texts) for c in swaps(set(t), sets)]
    df, hits = np.zeros(len(names)), np.zeros(len(names))
    for r, label in zip(rows, labels):
        df[r] += 1
        hits[r] += label
    p = y.mean()
    strength = np.abs(hits - df * p) / np.sqrt(df * p * (1 - p) + 1e-9)
    by_number = list(names)
    kept = sorted((f for f in np.flatnonzero((df >= s.min_texts) & (strength >= 2)).tolist()),
                  key=lambda f: (-round(strength[f], 9), by_number[f]))[:s.max_features]
    at = np.full(len(names), -1)
    at[kept] = np.arange(len(kept))
    kept_of = lambda r: [c for c in at[r].tolist() if c >= 0]
    idx = [kept_of(r) for r in rows]
    pairs = [(i, kept_of(r)) for i, r in swapped]
    x = Rows(idx, len(kept))
    a, b = Rows([idx[i] for i, _ in pairs], len(kept)), Rows([c for _, c in pairs], len(kept))
    # A step for each feature, from a bound on the curvature of the loss along it.
    size = np.bincount(x.row, minlength=x.n)
    bend = 0.25 * x.back(size.astype(float) + 1) / x.n + 1e-3
    if pairs:
        wide = np.bincount(a.row, minlength=a.n) + np.bincount(b.row, minlength=b.n)
        bend += 2 * s.fairness * (a.back(wide.astype(float)) + b.back(wide.astype(float))) / len(pairs)
    w, old, b0 = np.zeros(len(kept)), np.zeros(len(kept)), bias
    for step in range(s.steps):
        at_w = w + step / (step + 3) * (w - old)
        r = (C.sigmoid(x.dot(at_w) + b0) - y) / x.n
        g = x.back(r)
        if pairs:
            change = 2 * s.fairness * (a.dot(at_w) - b.dot(at_w)) / len(pairs)
            g += a.back(change) - b.back(change)
        old, move = w, at_w - g / bend
        w = np.sign(move) * np.maximum(np.abs(move) - s.l1 / bend, 0)
        b0 -= 2.0 * r.sum()
    return {"bias": float(b0), "weights": {by_number[f]: float(w[i]) for i, f in enumerate(kept) if w[i]}}


def fit(documents: DataFrame, labels: DataFrame, learn: Column, s: Settings = Settings(), label: str = "toxic",
        sets=IDENTITY_SETS) -> dict:
    """The model from at most ``train_rows`` labelled documents, fitted in one task (retried if its executor is lost)."""
    C.ship(documents.sparkSession)
    sample = C.labelled_sample(documents, labels, label, learn, s.train_rows)

    def distinct_words(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast("int64"), batch.column("label").cast("int32"),
                 pa.array([sorted(words_of(t)) for t in C.texts(batch)], pa.list_(pa.string()))],
                names=["doc_id", "label", "words"])

    def fit_all(batches):
        one: dict[str, str] = {}                  # one copy of each word in memory
        rows = [(d, y, tuple(one.setdefault(w, w) for w in ws)) for b in batches for d, y, ws in
                zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("words").to_pylist())]
        rows.sort(key=lambda r: r[0])
        model = fit_rows([r[2] for r in rows], [r[1] for r in rows], s, sets)
        items = list(model["weights"].items())
        yield pa.RecordBatch.from_arrays([pa.array([None, *(k for k, _ in items)], pa.string()),
                                          pa.array([model["bias"], *(v for _, v in items)], pa.float64())],
                                         names=["word", "weight"])

    rows = C.stored(sample.mapInArrow(C.tidy(distinct_words), "doc_id long, label int, words array<string>"), "toxicity-words")
    got = rows.coalesce(1).mapInArrow(C.tidy(fit_all), "word string, weight double").collect()
    return {"bias": sum(r["weight"] for r in got if r["word"] is None),
            "weights": {r["word"]: r["weight"] for r in got if r["word"] is not None}}


class Scorer:
    """Scores texts; remembers which features with a weight a word brings, up to a bound."""

    def __init__(self, model: dict, s: Settings = Settings()):
        self.bias, self.weights, self.bound = model["bias"], model["weights"], s.cache
        self.of: dict[str, tuple] = {}

    def __call__(self, text: str) -> float:
        found: set[str] = set()
        for w in words_of(text):
            has = self.of.get(w)
            if has is None:
                if len(self.of) >= self.bound:
                    self.of.clear()
                has = self.of[w] = tuple(f for f in features_of({w}) if f in self.weights)
            if has:
                found.update(has)
        return float(C.sigmoid(self.bias + sum(self.weights[f] for f in sorted(found))))


def score(documents: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every document (doc_id, text)."""
    C.ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast("int64"), pa.array([scorer(t) for t in C.texts(batch)], pa.float64())],
                names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(C.tidy(run), "doc_id long, score double")


def drop_toxic(documents: DataFrame, model: dict, threshold: float = Settings.threshold) -> DataFrame:
    """The documents scored below ``threshold``, with all their columns."""
    C.ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < threshold for t in C.texts(batch)], pa.bool_()))

    return documents.mapInArrow(C.tidy(run), documents.schema)

"""Quality classifier: a factorisation machine over hashed words, structure and length.

score(x) = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the
pairwise sum is computed in linear time as half of sum_f (sum_i v_if x_i)^2 -
sum_i (v_if x_i)^2.  Inputs are the distinct words (hashed; together of unit
length), binned statistics of the text's structure, and its binned length.

The fit uses a bounded, documented number of labelled rows in one task; scoring
covers every row and text.

Defined cases: a null or empty text has its own structure bins and gets a score
like any other; rows are scored one by one, so repeated rows agree; without
labels of both kinds the score is the smoothed base rate; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from tranche.llm import common as C
from tranche.llm.quality_rules import CLASSES, char_histogram, repeated_lines


@dataclass(frozen=True)
class Settings:
    train_rows: int = 8_000       # labelled rows fitted on, by hash of the id
    bits: int = 16                 # hashed words fall into 2^bits inputs
    factors: int = 4
    steps: int = 50
    rate: float = 0.05
    decay: float = 1e-4            # L2 penalty
    threshold: float = 0.7
    cache: int = 150_000           # words a worker remembers at most


BINS = 12
STATISTICS = ("words", "chars", "word_length", "upper", "digit", "point", "symbol", "other", "far",
              "distinct_words", "same_as_previous", "repeated_lines", "words_a_line", "bars", "marked_words",
              "top_word")


def structure(raw: bytes) -> list[int]:
    """The bin of each statistic."""
    words = raw.split()
    n = len(words)
    h = char_histogram(raw)
    chars = int(h.sum())
    share = dict(zip(CLASSES, (h / max(chars, 1)).tolist()))
    log_bin = lambda v, step: min(int(np.log2(1 + v) / step), BINS - 1)
    rate_bin = lambda v: min(int(np.ceil(np.sqrt(min(max(v, 0.0), 1.0)) * (BINS - 1) - 1e-9)), BINS - 1)
    counts: dict[bytes, int] = {}
    same = marked = 0
    last = None
    for w in words:
        counts[w] = counts.get(w, 0) + 1
        same += w == last
        last = w
    for w, k in counts.items():
        if w[-1:] in b"!#*$%&|<>":
            marked += k
    lines = [x for x in raw.split(b"\n") if x.strip()]
    per_word = 1 / max(n, 1)
    return [log_bin(n, 1.3), log_bin(chars, 1.5), log_bin(chars * per_word, 0.5), rate_bin(share["upper"]),
            rate_bin(share["digit"]), rate_bin(share["point"]), rate_bin(share["symbol"]), rate_bin(share["other_ascii"]),
            rate_bin(share["far_lower"] + share["far_upper"] + share["far_other"]), rate_bin(len(counts) * per_word),
            rate_bin(same * per_word), rate_bin(repeated_lines(raw) / max(len(lines), 1)),
            log_bin(n / max(len(lines), 1), 1.0), rate_bin(raw.count(b"|") * per_word), rate_bin(marked * per_word),
            rate_bin(max(counts.values(), default=0) * per_word)]


class Features:
    """Positions and values of a text's inputs; remembers word hashes, up to a bound."""

    def __init__(self, s: Settings):
        self.s, self.at = s, {}
        self.width = (1 << s.bits) + BINS * len(STATISTICS)

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > self.s.cache:
            self.at.clear()
        at, mask = self.at, (1 << self.s.bits) - 1
        found = set()
        for w in set(raw.lower().split()):
            i = at.get(w)
            if i is None:
                i = at[w] = xxhash.xxh64_intdigest(w) & mask
            found.add(i)
        bins = [(1 << self.s.bits) + BINS * k + b for k, b in enumerate(structure(raw))]
        cols = np.array([*sorted(found), *bins], np.int32)
        vals = np.full(len(cols), 1.0 / np.sqrt(len(found)) if found else 0.0, np.float32)
        vals[len(found):] = 1.0 / np.sqrt(len(bins))
        return cols, vals


def forward(rows: list, model: dict) -> tuple:
    """Scores before the sigmoid, with what the gradient needs."""
    cols = np.concatenate([r[0] for r in rows])
    vals = np.concatenate([r[1] for r in rows])
    starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
    return (cols, vals, starts, *products(cols, vals, starts, model))


def products(cols, vals, starts, model) -> tuple:
    z = model["b"] + np.add.reduceat(model["w"][cols] * vals, starts)
    vx = model["v"][:, cols] * vals                                  # factors x inputs
    sums = np.add.reduceat(vx, starts, axis=1)
    z = z + 0.5 * (sums ** 2 - np.add.reduceat(vx ** 2, starts, axis=1)).sum(axis=0)
    return z, vx, sums


def fit_rows(rows: list, labels: list[int], s: Settings) -> dict:
    """Full-batch Adam on logistic loss with an L2 penalty; starts from a fixed seed."""
    width = (1 << s.bits) + BINS * len(STATISTICS)
    y = np.array(labels, float)
    rate = (y.sum() + 1) / (len(y) + 2)
    model = {"b": float(np.log(rate / (1 - rate))), "w": np.zeros(width, np.float32),
             "v": np.zeros((s.factors, width), np.float32)}
    if len(set(labels)) < 2:
        return model
    model["v"] = np.random.default_rng(7).normal(0, 0.05, (s.factors, width)).astype(np.float32)
    cols, vals, starts = forward(rows, model)[:3]
    row = np.repeat(np.arange(len(rows)), np.diff([*starts, len(cols)]))
    first = {k: np.zeros_like(model[k]) for k in ("w", "v")}
    second = {k: np.zeros_like(model[k]) for k in ("w", "v")}
    for step in range(1, s.steps + 1):
        z, vx, sums = products(cols, vals, starts, model)
        r = ((C.sigmoid(z) - y) / len(y))
        per = (r[row] * vals).astype(np.float32)
        grad = {"w": np.bincount(cols, per, width),
                "v": np.stack([np.bincount(cols, per * (sums[f][row] - vx[f]), width) for f in range(s.factors)])}
        model["b"] -= 20 * s.rate * float(r.sum())
        for k, g in grad.items():
            g = g + s.decay * model[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)
            model[k] = (model[k] - s.rate * move).astype(np.float32)
    return model


def score_rows(raws: list[bytes], features: Features, model: dict) -> np.ndarray:
    if not raws:
        return np.zeros(0)
    return C.sigmoid(forward([features(r) for r in raws], model)[3].astype(float))


def fit(documents: DataFrame, labels: DataFrame, learn: Column, s: Settings = Settings(), label: str = "quality") -> dict:
    """The model from at most ``train_rows`` labelled documents, fitted in one task (retried if its executor is lost)."""
    C.ship(documents.sparkSession)
    sample = C.labelled_sample(documents, labels, label, learn, s.train_rows)

    def inputs(batches):
        features = Features(s)
        for batch in batches:
            got = [features(r) for r in C.raw_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast("int64"), batch.column("label").cast("int32"),
                 pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
                names=["doc_id", "label", "cols", "vals"])

    def fit_all(batches):
        rows = [(d, y, c.values.to_numpy(), v.values.to_numpy()) for b in batches for d, y, c, v in
                zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("cols"), b.column("vals"))]
        rows.sort(key=lambda r: r[0])
        m = fit_rows([(r[2], r[3]) for r in rows], [int(r[1] > 0) for r in rows], s)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m["b"]]), pa.array([m["w"].tobytes()]), pa.array([m["v"].tobytes()])], names=["b", "w", "v"])

    rows = C.stored(sample.mapInArrow(inputs, "doc_id long, label int, cols array<int>, vals array<float>"), "quality-inputs")
    got = rows.coalesce(1).mapInArrow(fit_all, "b double, w binary, v binary").collect()
    if not got:                                   # no partition at all, so no labelled row
        return fit_rows([], [], s)
    return {"b": got[0]["b"], "w": np.frombuffer(got[0]["w"], np.float32),
            "v": np.frombuffer(got[0]["v"], np.float32).reshape(s.factors, -1)}


def score(documents: DataFrame, model: dict, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every document (doc_id, text)."""
    C.ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        features = Features(s)
        for batch in batches:
            got = np.concatenate([np.zeros(0), *(score_rows(list(C.raw_texts(some)), features, sent.value) for some in C.slices(batch))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast("int64"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")

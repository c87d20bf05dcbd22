"""Language identification, word first: a known word scores by its frequency in each
language, an unknown one backs off to its character n-grams, long ones first.

The model holds, for each language, log frequencies of the commonest words and
of character n-grams.  A word in the vocabulary is scored by its own
frequencies; another by the known n-grams of the longest length that has any
(5, then 4, ... 1), each with a penalty for the steps taken.  Words add up to a
text's log-likelihood per language; the score is the share of the best language
in a softmax of the mean per word, sharpened by a fixed temperature.

Every language is learned, from at most ``texts`` different labelled texts of it, so a
rare one counts as much as a common one.  The model is sparse: of each key only the
languages that have it are stored.  It keeps ``words`` words and ``grams`` n-grams of
each length a language; with so many languages that this would come to more than
``keys`` in all, evenly fewer of each.

Defined cases: a null text, and one without a letter (a character that Unicode calls
a letter; numerals such as the half sign are none), is ``und`` with score 0; rows are
judged one by one, repeated ones alike; a word ends at all that is no letter; very long
texts are read whole, and each distinct token of theirs is scored once; ties go to the language first in the alphabet; a null lang is never learned
from, nor is a row without an id; extra columns are never read; with nothing to learn
from, every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tranche.llm import common as C

UND = "und"
LENGTHS = (5, 4, 3, 2, 1)


@dataclass(frozen=True)
class Settings:
    texts: int = 3_000             # different labelled texts of a language that are learned from, by hash of id and text
    words: int = 20_000            # vocabulary: the commonest words of each language
    grams: int = 8_000             # n-grams kept of each length and language
    keys: int = 6_000_000          # words and n-grams of all languages together
    backoff: float = 0.4           # factor for every shorter n-gram length
    sharpness: float = 4.0         # of the softmax over the mean score of a word
    cache: int = 200_000           # tokens a worker remembers, and as many of the time before
    cached_numbers: int = 8_000_000    # fewer tokens if their scores are more numbers than this


#: ASCII letters lower-cased, other ASCII to spaces, bytes of other characters kept.
_CUT = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def tokens_of(text: bytes) -> Counter:
    """The tokens of a text in UTF-8: what stands between ASCII characters that are no letters."""
    return Counter(text.translate(_CUT).split())


def words_of(token: bytes) -> list[str]:
    """The words of a token: lower-cased runs of letters."""
    low = token.decode()
    if token.isascii():
        return [low]
    low = low.lower()
    return [low] if low.isalpha() else "".join(c if c.isalpha() else " " for c in low).split()


def _word_counts(flush: int = 200_000):
    """(lang, word, n) of the texts of a partition."""

    def rows(held):
        out = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                          names=["lang", "word", "n"])

    def run(batches):
        held: dict = defaultdict(Counter)
        for batch in batches:
            for few in C.slices(batch):
                for lang, text in zip(few.column("lang").to_pylist(), C.raw_texts(few)):
                    for token, n in tokens_of(text).items():
                        for w in words_of(token):
                            held[lang][w] += n
                if sum(map(len, held.values())) > flush:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return run


def _gram_counts(batches):
    """(lang, size, key, n): n-grams of words (lang, word), each word counted once."""
    for batch in batches:
        held: Counter = Counter()
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist()):
            padded = f" {word} "
            held.update((lang, k, padded[i:i + k]) for k in LENGTHS for i in range(len(padded) - k + 1))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in held], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
                                         + [pa.array(list(held.values()), pa.int64())], names=["lang", "size", "key", "n"])


def learned_texts(documents: DataFrame, learn: Column, s: Settings) -> DataFrame:
    """(lang, text) of at most ``texts`` different (doc_id, text) of each language, those of the smallest hashes.

    Chosen on narrow rows; equal rows count once, so one id or text that holds
    many rows takes one place.
    """
    labelled = (documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learn)
                .select("doc_id", "lang", "text", F.xxhash64("text").alias("of_text")))
    key = ["lang", "doc_id", "of_text"]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "of_text"), "doc_id", "of_text"))
    chosen = C.stored(labelled.select(*key).distinct().withColumn("place", place).where(F.col("place") <= s.texts).drop("place"), "learned-ids")
    if chosen.limit(500_001).count() <= 500_000:
        chosen = F.broadcast(chosen)
    return labelled.join(chosen, key, "left_semi").dropDuplicates(key).select("lang", "text")


def fit(documents: DataFrame, learn: Column, settings: Settings = Settings()) -> dict:
    """The model from (doc_id, text, lang) rows where ``learn`` holds and lang is not null.

    Counting is distributed; the driver receives the commonest words and n-grams of
    each language, ``settings.keys`` at most.  For each length (0: words) the model has a
    number for each key, and of each key its languages and log frequencies.
    """
    C.ship(documents.sparkSession)
    words = C.stored(learned_texts(documents, learn, settings).mapInArrow(_word_counts(), "lang string, word string, n long")
                     .groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    model: dict = {"langs": langs, "tables": {}}
    grams = C.stored(words.mapInArrow(_gram_counts, "lang string, size int, key string, n long")
                     .groupBy("lang", "size", "key").agg(F.sum("n").alias("n")), "language-grams")
    fit_in = min(1.0, settings.keys / max(1, len(langs) * (settings.words + len(LENGTHS) * settings.grams)))
    place = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "key"))

    def top(counts: DataFrame, most: int) -> list[dict]:
        kept = counts.withColumn("place", place).where(F.col("place") <= max(1, int(most * fit_in)))
        return kept.select("lang", "size", "key", "n").toArrow().to_pylist()

    found = (top(words.select("lang", F.lit(0).alias("size"), F.col("word").alias("key"), "n"), settings.words)
             + top(grams, settings.grams)) if langs else []
    at, by_size = {lang: i for i, lang in enumerate(langs)}, defaultdict(list)
    for r in sorted(found, key=lambda r: (r["key"], r["lang"])):
        by_size[r["size"]].append(r)
    for size in (0, *LENGTHS):                     # counts to log frequencies, half a count for none
        rows = by_size[size]
        numbers = {key: i for i, key in enumerate(dict.fromkeys(r["key"] for r in rows))}
        lang, n = np.array([at[r["lang"]] for r in rows], np.int32), np.array([r["n"] for r in rows], np.float64)
        total = np.bincount(lang, n, len(langs)) + 0.5 * len(numbers) + 1e-9
        starts = np.searchsorted(np.array([numbers[r["key"]] for r in rows]), np.arange(len(numbers) + 1))
        model["tables"][size] = {"numbers": numbers, "starts": starts, "lang": lang,
                                 "log": np.log((n + 0.5) / total[lang]).astype(np.float32), "none": np.log(0.5 / total).astype(np.float32)}
    return model


class Scorer:
    """Scores texts; remembers the score rows of tokens, up to a bound: those used last, and those of the time before."""

    def __init__(self, model: dict, settings: Settings):
        self.langs, self.tables, self.s = model["langs"], model["tables"], settings
        self.bound = max(1, min(settings.cache, settings.cached_numbers // (len(self.langs) + 1)))
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1024, len(self.langs) + 1))
        self.at_before, self.rows_before = self.at, self.rows

    def _dense(self, size: int, ids: np.ndarray) -> np.ndarray:
        """Log frequencies in every language of the keys with these numbers."""
        t = self.tables[size]
        out = np.tile(t["none"], (len(ids), 1))
        starts, n = t["starts"][ids], t["starts"][ids + 1] - t["starts"][ids]
        row = np.repeat(np.arange(len(ids)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        out[row, t["lang"][at]] = t["log"][at]
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, the best language at 0."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        vocabulary = self.tables[0]["numbers"]
        hits = [(i, vocabulary[w]) for i, w in enumerate(words) if w in vocabulary]
        if hits:
            at, ids = (np.array(x) for x in zip(*hits))
            row = self._dense(0, ids)
            out[at] = row - row.max(axis=1, keepdims=True)
        left = [(i, f" {w} ") for i, w in enumerate(words) if w not in vocabulary]
        for step, k in enumerate(LENGTHS):               # the longest length that knows any n-gram of the word
            numbers = self.tables[k]["numbers"]
            at, starts, grams, shorter = [], [], [], []
            for i, padded in left:
                known = [numbers[g] for g in [padded[j:j + k] for j in range(len(padded) - k + 1)] if g in numbers]
                if known:
                    at.append(i)
                    starts.append(len(grams))
                    grams += known
                else:
                    shorter.append((i, padded))
            if at:
                ids, place = np.unique(np.array(grams), return_inverse=True)
                row = np.add.reduceat(self._dense(k, ids)[place], starts, axis=0)
                n = np.diff([*starts, len(grams)])[:, None].astype(np.float32)
                out[at] = (row - row.max(axis=1, keepdims=True)) / n * np.float32(self.s.backoff ** (step / 2))
            left = shorter
        return out

    def _turn(self, most: int) -> None:
        """With more than ``most`` tokens remembered, begin a new time."""
        if len(self.at) > most:
            self.at_before, self.rows_before, self.at, self.rows = self.at, self.rows, {}, np.zeros_like(self.rows[:1024])

    def _learn(self, tokens: list[bytes]) -> None:
        """Rows of tokens not remembered: the sums of their words' rows, and in the last column the number of words."""
        first = len(self.at)
        while first + len(tokens) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        rows, before = self.rows[first:first + len(tokens)], self.at_before
        rows[:] = 0
        again = [(i, before[t]) for i, t in enumerate(tokens) if t in before]
        if again:
            at, old = zip(*again)
            rows[list(at)] = self.rows_before[list(old)]
        parts = [(i, w) for i, t in enumerate(tokens) if t not in before for w in words_of(t)]
        some = max(1, self.s.cached_numbers // (16 * (len(self.langs) + 1)))
        for j in range(0, len(parts), some):
            at, words = zip(*parts[j:j + some])
            of, starts, n = np.unique(np.array(at), return_index=True, return_counts=True)
            rows[of, :-1] += np.add.reduceat(self.words(list(words)), starts, axis=0)
            rows[of, -1] += n
        self.at.update(zip(tokens, range(first, first + len(tokens))))

    def _sum(self, counts: Counter) -> np.ndarray:
        """The sum of the rows of a text's tokens, each as often as it occurs."""
        total, some = np.zeros(len(self.langs) + 1), max(1, self.s.cached_numbers // (8 * (len(self.langs) + 1)))
        tokens = list(counts)
        for j in range(0, len(tokens), some):
            few = tokens[j:j + some]
            self._turn(2 * self.bound)                           # a text of very many tokens
            new = [t for t in few if t not in self.at]
            if new:
                self._learn(new)
            idx = list(map(self.at.__getitem__, few))
            total += np.fromiter(map(counts.__getitem__, few), np.float64, len(few)) @ self.rows[idx]
        return total

    def many(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """(language, score) of texts in UTF-8, their new tokens scored together."""
        if not self.langs:
            return [(UND, 0.0)] * len(texts)
        self._turn(self.bound)
        counted = [tokens_of(t) for t in texts]
        new = {t for counts in counted for t in counts if t not in self.at}
        if new and len(new) <= self.bound:
            self._learn(list(new))
        return [self._best(self._sum(counts)) for counts in counted]

    def _best(self, total: np.ndarray) -> tuple[str, float]:
        if not total[-1]:
            return UND, 0.0
        mean = total[:-1] / total[-1]
        p = np.exp(self.s.sharpness * (mean - mean.max()))
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())

    def __call__(self, text: str) -> tuple[str, float]:
        return self.many([text.encode()])[0]


def predict(documents: DataFrame, model: dict, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, lang_pred, score) of every document (doc_id, text)."""
    C.ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value, settings)
        for batch in batches:
            for few in C.slices(batch):
                got = scorer.many(list(C.raw_texts(few)))
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id").cast("int64"), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")

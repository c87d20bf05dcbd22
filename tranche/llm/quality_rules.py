"""Quality rules: rule counts of every text, and divergence from its language's histograms.

Two histograms describe a text: its characters by class, and its words among
the commonest short words of a language (all others in one more bin).  Both are
compared, by Jensen-Shannon distance, with the same histograms of all documents
of the language.  A text too short for a histogram is not judged by it.

The limits of both distances follow a language's own documents, counted on the
executors.  A word histogram of few words is far from any other by chance, so the
word limit is set by length: the median and so many times the spread below it,
which junk (at the far end) does not move.  The character limit is a high quantile
of the documents within the word limit.  No limit is above the fixed ones, which
hold where there are too few documents to count.

Defined cases: a null text is empty (all counts 0, ``base_failed``); rows are
judged one by one, so repeated rows get equal results; a null, empty or scarce
language has no reference of its own, and the nearest of all references counts
(within that one's limits if no language is named, within the fixed limits if a
scarce one is); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tranche.llm import common as C

CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "other_ascii",
           "far_lower", "far_upper", "far_other")
SPACES, POINTS, SYMBOLS = " \t\n\x0b\x0c\r", ".,;:!?'\"-()", "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; distances are Jensen-Shannon distances in bits, 0 to 1."""

    min_words: int = 20
    max_repeat_pct: int = 30          # of words within repeated 8-word windows
    max_char_distance: float = 0.35   # a language's own documents set a lower one
    min_chars: int = 100              # guard: fewer characters give no histogram
    max_word_distance: float = 0.50   # as above
    min_hist_words: int = 50          # guard: fewer words give no histogram
    common_words: int = 64            # of each language
    max_word_chars: int = 6           # common words are short (bytes)
    min_reference_words: int = 2_000  # a language with fewer has no reference of its own
    word_spread: float = 3.0          # standard deviations above the median, taken from the 10th percentile
    char_quantile: float = 0.999      # of the documents within the word limit
    min_limit_docs: int = 30          # fewer documents of a length (or language) set no limit


def _class_table() -> np.ndarray:
    out = np.full(65536, CLASSES.index("far_other"), np.uint8)
    for cp in range(65536):
        ch = chr(cp)
        if cp < 128:
            name = ("space" if ch in SPACES else "symbol" if ch in SYMBOLS else "point" if ch in POINTS
                    else "digit" if ch.isdigit() else "lower" if ch.islower() else "upper" if ch.isupper()
                    else "other_ascii")
            out[cp] = CLASSES.index(name)
        elif ch.isalpha():
            out[cp] = CLASSES.index("far_upper" if ch.isupper() else "far_lower")
    return out


_TABLE: list[np.ndarray] = []


def char_histogram(raw: bytes) -> np.ndarray:
    """Code points of a text by class."""
    if not _TABLE:
        _TABLE.append(_class_table())
    cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    return np.bincount(_TABLE[0][np.minimum(cps, 65535)], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    code = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    for span in (1, 2, 4):                       # window hashes of 2, 4, then 8 words
        code = (code[:-span] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[span:] + (code[:-span] >> np.uint64(29)))
    if len(np.unique(code)) == len(code):        # no equal hashes, so no equal windows
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    for span in (1, 2, 4):                       # exact: ranks of word sequences, doubled in length
        rank = np.unique(rank[:-span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)[1]
    at = np.flatnonzero(np.bincount(rank)[rank] >= 2)
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def repeated_lines(raw: bytes) -> int:
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms with a positive sum."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


_COUNTS = "lang string, kind string, key string, n long"


def _profile(max_word_chars: int, flush: int = 200_000):
    """Per partition: characters by class, and short words, by language."""

    def run(batches):
        chars: dict = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))
        words: dict = defaultdict(Counter)

        def rows():
            out = [(g, "c", name, int(v)) for g, h in chars.items() for name, v in zip(CLASSES, h) if v]
            out += [(g, "w", w.decode("utf-8", "replace"), n) for g, c in words.items() for w, n in c.items()]
            chars.clear()
            words.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
                names=["lang", "kind", "key", "n"])

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), C.raw_texts(batch)):
                chars[lang] += char_histogram(raw)
                found = Counter(raw.lower().split())
                c = words[lang]
                c[b""] += sum(found.values())                  # all words, under the empty key
                for w, n in found.items():
                    if len(w) <= max_word_chars:
                        c[w] += n
            if sum(map(len, words.values())) > flush:
                yield rows()
        yield rows()

    return run


def references(documents: DataFrame, rules: Rules = Rules()) -> dict[str, tuple]:
    """Reference of each language: (character histogram, common words, word histogram).

    Counts cover all documents with a language and do not depend on how they are
    split.  Every language of ``min_reference_words`` words or more has a reference; of
    each, its common words and class counts reach the driver, some 4 kB.
    """
    counts = (documents.select("lang", "text").where("lang != ''").mapInArrow(C.tidy(_profile(rules.max_word_chars)), _COUNTS)
              .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    counts = C.stored(counts, "quality-counts")
    whole = (F.col("kind") == "w") & (F.col("key") == "")
    langs = counts.where(whole & (F.col("n") >= rules.min_reference_words)).select("lang", F.col("n").alias("total"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    rows = (counts.where(~whole).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= rules.common_words)
            .join(langs, "lang").orderBy("lang", "kind", "rank").collect())
    chars, common, words = defaultdict(dict), defaultdict(list), {}
    for r in rows:
        words[r["lang"]] = r["total"]
        if r["kind"] == "c":
            chars[r["lang"]][r["key"]] = r["n"]
        else:
            common[r["lang"]].append((r["key"].encode(), r["n"]))
    out = {}
    for lang, total in words.items():
        hist = [n for _, n in common[lang]]
        out[lang] = (np.array([chars[lang].get(c, 0) for c in CLASSES], float), [w for w, _ in common[lang]],
                     np.array([*hist, max(total - sum(hist), 0)], float))
    return out


def length_class(n: int) -> int:
    """Two classes for each doubling of the words."""
    return int(2 * np.log2(max(n, 1)))


def _own_distances(refs: dict, rules: Rules, flush: int = 100_000):
    """Per partition: documents by language, length and distances (in thousandths, up) that pass the other rules."""

    def run(batches):
        found: Counter = Counter()

        def rows():
            out = [(*k, n) for k, n in found.items()]
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), *[pa.int64()] * 4))],
                names=["lang", "length", "c", "w", "n"])

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), C.raw_texts(batch)):
                if lang not in refs:
                    continue
                got = judge(raw, lang, refs, rules)
                if not got[5] and got[8] is not None:
                    c = None if got[7] is None else int(np.ceil(1000 * got[7]))
                    found[lang, length_class(got[0]), c, int(np.ceil(1000 * got[8]))] += 1
            if len(found) > flush:
                yield rows()
        yield rows()

    return run


def limits(documents: DataFrame, refs: dict, rules: Rules = Rules()) -> dict[str, tuple]:
    """Limits of each language with a reference: (character distance, {length class: word distance}).

    Counts cover all documents; a few numbers for each language and length reach the driver.
    """
    if not refs:
        return {}
    counts = (documents.select("lang", "text").mapInArrow(C.tidy(_own_distances(refs, rules)), "lang string, length long, c long, w long, n long")
              .groupBy("lang", "length", "c", "w").agg(F.sum("n").alias("n")))
    counts = C.stored(counts, "quality-distances")
    by_length = (counts.groupBy("lang", "length").agg(F.sum("n").alias("docs"), F.percentile("w", [0.1, 0.5], F.col("n")).alias("at"))
                 .where(F.col("docs") >= rules.min_limit_docs).collect())
    words: dict = {lang: {} for lang in refs}
    for r in by_length:
        low, mid = r["at"]
        words[r["lang"]][r["length"]] = min(rules.max_word_distance, (mid + rules.word_spread * (mid - low) / 1.2816) / 1000)
    for w in words.values():                     # a length with few documents: the limit of the next shorter one
        for k in range(1, 128):
            if k not in w and k - 1 in w:
                w[k] = w[k - 1]
    near = counts.sparkSession.createDataFrame([(lang, k, 1000 * v) for lang, w in words.items() for k, v in w.items()],
                                               "lang string, length long, most double")
    by_lang = (counts.where("c IS NOT NULL").join(F.broadcast(near), ["lang", "length"]).where("w <= most")
               .groupBy("lang").agg(F.sum("n").alias("docs"), F.percentile("c", rules.char_quantile, F.col("n")).alias("at"))
               .where(F.col("docs") >= rules.min_limit_docs).collect())
    chars = {r["lang"]: min(rules.max_char_distance, r["at"] / 1000) for r in by_lang}
    return {lang: (chars.get(lang, rules.max_char_distance), w) for lang, w in words.items()}


def judge(raw: bytes, lang: str | None, refs: dict, rules: Rules, own: dict | None = None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char, word distance).

    ``own``: the languages' limits; where one has none, the fixed limits hold.
    """
    words = raw.split()
    n = len(words)
    hist = char_histogram(raw)
    chars = int(hist.sum() - hist[CLASSES.index("space")])
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_pct * n
    near = [lang] if lang in refs else list(refs)
    set_by = {} if own is None or (lang and lang not in refs) else own      # a scarce language has no limits of its own
    far_c = far_w = None
    fits = not near
    found = Counter(raw.lower().split()) if near and n >= rules.min_hist_words else {}
    for name in near:
        chars_of, common, words_of = refs[name]
        max_c, by_length = set_by.get(name, (rules.max_char_distance, {}))
        fit = True
        if hist.sum() >= rules.min_chars:
            c = js_distance(hist.astype(float), chars_of)
            far_c = c if far_c is None else min(far_c, c)
            fit = c <= max_c
        if n >= rules.min_hist_words:
            seen = [found.get(w, 0) for w in common]
            w = js_distance(np.array([*seen, n - sum(seen)], float), words_of)
            far_w = w if far_w is None else min(far_w, w)
            fit = fit and w <= by_length.get(length_class(n), rules.max_word_distance)
        fits = fits or fit
    kept = not failed and fits
    return n, chars, int(hist[CLASSES.index("symbol")]), repeated_lines(raw), repeat, failed, kept, far_c, far_w


_FIELDS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
           ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
           ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()))
_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, char_distance double, word_distance double")


def quality_report(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document (doc_id, lang, text): the rule counts, both distances and the verdict."""
    C.ship(documents.sparkSession)
    refs = references(documents, rules)
    sent = documents.sparkSession.sparkContext.broadcast((refs, limits(documents, refs, rules)))

    def run(batches):
        refs, own = sent.value
        for batch in batches:
            got = [judge(raw, lang, refs, rules, own)
                   for raw, lang in zip(C.raw_texts(batch), batch.column("lang").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast("int64"), *(pa.array([g[i] for g in got], t) for i, (_, t) in enumerate(_FIELDS))],
                names=["doc_id", *(n for n, _ in _FIELDS)])

    return documents.select("doc_id", "lang", "text").mapInArrow(C.tidy(run), _SCHEMA)


def keep_good(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    C.ship(documents.sparkSession)
    refs = references(documents, rules)
    sent = documents.sparkSession.sparkContext.broadcast((refs, limits(documents, refs, rules)))

    def run(batches):
        refs, own = sent.value
        for batch in batches:
            yield batch.filter(pa.array([judge(raw, lang, refs, rules, own)[6] for raw, lang in
                                         zip(C.raw_texts(batch), batch.column("lang").to_pylist())], pa.bool_()))

    return documents.mapInArrow(C.tidy(run), documents.schema)

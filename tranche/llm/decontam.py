"""Benchmark decontamination: a prefix-filtered set join on word shingles.

A document is hit where a whole window of an item's words occurs in it.  A
window's shingles all have to be there, so of its shingles, ordered by how often
they occur in all documents, a prefix of one - the rarest - is a necessary token:
only its occurrences are candidates.  Lengths and positions bound a candidate (the
window must fit before and after), then its words are compared exactly.

DataFrame functions only.  Documents are never shuffled: shingles are taken and
joined within the scan, and only matches move.  The benchmark's windows are
broadcast if there are at most ``broadcast_windows`` of them; beyond, candidate
positions are found by a shuffled join on hashes alone and verified afterwards.

Defined cases: null texts and ids of items: an item without words or id has no
windows; a null document text has no words; repeated rows and copies get equal
results, each its own row; a null doc_id is kept; empty tables give no rows, or
rows without hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tranche.llm import common as C

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    window: int = 10                     # words of an item that have to occur together
    shingle: int = 3                     # words of a token of the prefix filter
    broadcast_windows: int = 500_000     # more windows than this are joined by shuffling


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are (lower() does the same where there are no other capitals)."""
    others = text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(others, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def split_words(text: Column) -> Column:
    """Words in order; an empty string may stand first or last, where a text begins or ends with separators."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS)


def n_words(words: Column) -> Column:
    n = F.size(words)
    return (n - (words[0] == "").cast("int") - ((n > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def shingle_hash(words: Column, at: Column, size: int) -> Column:
    """Hash of up to ``size`` words from a position (0-based) on."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def item_windows(benchmark: DataFrame, s: Settings) -> DataFrame:
    """(item_id, words) of every window of every item."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), SEPARATORS), "")
    items = (benchmark.where(F.col("item_id").isNotNull())
             .select(F.col("item_id").cast("string").alias("item_id"), words.alias("all")).where(F.size("all") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - s.window + 1, F.lit(1)))
    return (items.select("item_id", "all", F.explode(starts).alias("at"))
            .select("item_id", F.slice("all", F.col("at"), F.lit(s.window)).alias("words")))


def positions(documents: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle position of every document: (doc_id, text_hash, words, pos, token)."""
    words = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), split_words(F.col("text")).alias("words"))
    at = words.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "word"))
    hashes = [shingle_hash(F.col("words"), F.col("pos"), k) for k in sizes]
    if len(hashes) == 1:
        return at.select("doc_id", "text_hash", "words", "pos", hashes[0].alias("token"))
    return at.select("doc_id", "text_hash", "words", "pos", F.explode(F.array(*hashes)).alias("token"))


def matches(documents: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, start, n, window_id) of every occurring window, and (window_id, item_id)."""
    spark = documents.sparkSession
    items = C.stored(item_windows(benchmark, s).groupBy("words").agg(F.collect_set("item_id").alias("items"))
                     .withColumn("window_id", F.monotonically_increasing_id())
                     .withColumn("n", F.size("words"))
                     .withColumn("k", F.least(F.col("n"), F.lit(s.shingle))), "benchmark-windows")
    shape = items.agg(F.count(F.lit(1)).alias("windows"), F.collect_set("k").alias("sizes")).first()
    small = shape["windows"] <= s.broadcast_windows
    near = F.broadcast if small else (lambda df: df)
    sizes = sorted(shape["sizes"]) or [s.shingle]

    # Tokens of every window, each with its place in the window.
    token = F.lit(None).cast("long")
    for k in sizes:
        token = F.when(F.col("k") == k, shingle_hash(F.col("words"), F.col("offset"), k)).otherwise(token)
    tokens = (items.select("window_id", "words", "n", "k", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("offset"))
              .withColumn("token", token))
    # Rarity: occurrences in all documents; a token without any rules its windows out.
    counts = C.stored(positions(documents, sizes).join(near(tokens.select("token").distinct()), "token")
                      .groupBy("token").agg(F.count(F.lit(1)).alias("df")), "benchmark-token-counts")
    seen = tokens.join(counts, "token", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce(F.col("df"), F.lit(0)).alias("df"), F.col("offset"), F.col("token"))).alias("rarest"))
    prefix = C.stored(items.join(seen.where(F.col("rarest.df") > 0), "window_id")
                      .select("window_id", F.col("words").alias("window"), "n", F.col("rarest.offset").alias("offset"),
                              F.col("rarest.token").alias("token")), "benchmark-prefixes")
    item_of = items.select("window_id", F.explode("items").alias("item_id"))

    fits = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("n") <= F.size("words"))
    same = F.slice("words", F.col("pos") - F.col("offset") + 1, F.col("n")) == F.col("window")
    found = ["doc_id", "text_hash", (F.col("pos") - F.col("offset")).alias("start"), "n", "window_id"]
    if small:
        return positions(documents, sizes).join(near(prefix), "token").where(fits).where(same).select(*found), item_of
    # Many windows: hashes alone are shuffled; candidates then meet their text again by its hash.
    light = positions(documents, sizes).select("doc_id", "text_hash", "pos", "token")
    candidates = light.join(prefix, "token").select("doc_id", "text_hash", "pos", "n", "window_id", "offset", "window")
    texts = documents.select(F.xxhash64("text").alias("text_hash"), "doc_id", split_words(F.col("text")).alias("words"))
    texts = texts.groupBy("text_hash", "doc_id").agg(F.first("words").alias("words"))
    met = candidates.alias("c").join(texts.alias("t"), (F.col("c.text_hash") == F.col("t.text_hash"))
                                     & F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")))
    return (met.select("c.*", "t.words").where(fits).where(same).select(*found)), item_of


def contamination(documents: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_words, n_hit, n_items, items (sorted), contaminated."""
    found, item_of = matches(documents, benchmark, s)
    found = C.stored(found, "benchmark-matches")
    key = ["doc_id", "text_hash"]
    spans = found.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["n"]).alias("end"),
                              (a["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).alias("hit")))
    hits = spans.select(*key, covered["hit"].alias("n_hit"))
    named = (found.select(*key, "window_id").distinct().join(item_of, "window_id")
             .groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    both = hits.alias("h").join(named.alias("i"), (F.col("h.text_hash") == F.col("i.text_hash"))
                                & F.col("h.doc_id").eqNullSafe(F.col("i.doc_id"))).select("h.*", "i.items")
    all_docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words(split_words(F.col("text"))).alias("n_words"))
    out = all_docs.alias("d").join(both.alias("b"), (F.col("d.text_hash") == F.col("b.text_hash"))
                                   & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    items = F.coalesce(F.col("b.items"), F.array().cast("array<string>"))
    return out.select("d.doc_id", "d.n_words", F.coalesce("b.n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.size(items).cast("long").alias("n_items"), items.alias("items"),
                      F.col("b.n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    narrow = documents.select("doc_id", "text")
    found, _ = matches(narrow, benchmark, s)
    bad = C.stored(found.select("doc_id", "text_hash").distinct(), "contaminated").select(
        F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    return documents.join(bad, documents["doc_id"].eqNullSafe(F.col("__bad_id"))
                          & (F.xxhash64(documents["text"]) == F.col("__bad_hash")), "left_anti")

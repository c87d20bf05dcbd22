"""Ranked search against scores added up term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tranche.llm import lexical as L
from tranche.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k=50):
    counted = [(i, Counter(words(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    length = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counted:
            score = 0
            for t in terms & set(c):
                m = 100 - 50 + 50 * sum(c.values()) * n_docs // length
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


def test_query_against_brute_force(spark):
    rows = lambda name, i: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(i, "text").collect()]
    assert found(QUERIES["op13_lexical_search"](spark, SF)) == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))


ITEMS = [("a", "The cat, the DOG."), ("b", None), (None, "ran after it all"), ("a", "текст ÀÉ"), ("c", "!!"), ("d", "nowhere at all"), ("a", "The cat, the DOG.")]


@pytest.mark.parametrize("settings", [{}, {"items_a_tile": 1, "documents_a_tile": 2}, {"exact": 1 << 34}, {"terms_a_pass": 3, "k": 2}, {"tasks": 1, "terms_a_tile": 2}])
def test_odd_rows(spark, odd_documents, settings):
    """Nulls, ties, repeated rows, very long texts, clashing columns, items of several rows; tiles and passes change nothing."""
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id string, text string, score int")
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    s = L.Settings(**settings)
    assert found(L.search(odd_documents, items, s)) == brute(docs, ITEMS, s.k)


def test_no_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    for df in (L.search(no_documents, items), L.search(odd_documents, items.limit(0)), L.search(no_documents, items.limit(0))):
        assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.count() == 0


def test_ties_and_repeated_rows_across_tasks(spark):
    rng = random.Random(3)
    docs = [(i % 70, " ".join(rng.choices(["x", "y", "z"], k=rng.choice([2, 3])))) for i in range(400)]
    items = [(1, "x"), (2, "y z"), (3, "q")]
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                   spark.createDataFrame(items, "item_id long, text string"), L.Settings(k=20, documents_a_tile=8))
    assert found(got) == brute(docs, items, 20)


def test_products_stay_exact():
    """With the heaviest weights, sums beyond 2**53 are cut into products below it."""
    n = 3000
    weights = np.full(n, 25_000, np.int64)
    tile = L.Tile([7], [list(range(n))], weights, L.Settings(terms_a_tile=n, exact=1 << 41))
    assert len(tile.parts) > 1 and all(25_000 * L.IMPACTS * len(some) < 1 << 41 for some, _ in tile.parts)
    impact = np.random.default_rng(0).integers(1, L.IMPACTS, n)
    got = tile.scores(1, np.zeros(n, np.int64), np.arange(n), impact)
    assert got.tolist() == [[int((weights * impact).sum())]]

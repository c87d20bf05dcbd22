"""Ranked lexical search: the best documents of each item by dense blocks of a matrix product.

Scores are whole numbers: a term's weight by its document frequency times its impact
by its frequency in the document and the document's length, summed over an item's
terms.  Items are taken in tiles; a tile's terms are numbered compactly, so that its
weights are a dense matrix of items and terms.  Documents are taken in tiles too, as a
dense matrix of documents and a tile's terms, and BLAS multiplies the two in float64.
The terms are cut so that no sum within one product can reach 2**53; products are
therefore exact, and are added up as 64-bit integers.

Every task keeps, for each item, the best documents it has met, and drops a document
only if ``k`` others precede it in the final order (score, then doc_id); a score equal
to the last kept one is never dropped before the ids are compared.  The tasks' lists
are merged by a window for each item; there are at most ``tasks`` lists for each item,
whatever the number of documents.

Items are a query set of any size: they are dealt into passes over the documents, each
of about ``terms_a_pass`` terms, so that what is broadcast is bounded.

Defined cases: null and empty texts, and texts without a term, have no terms, count
for nothing and are never returned; texts under one item_id are one item with the
terms of all of them, a null item_id being an id of its own; items without a term
return nothing; repeated rows of a document count and are ranked each; of equal scores
the smaller doc_id comes first, a null doc_id last; texts are read whole; extra
columns are never read; with no documents or items the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tranche.llm import common as C

#: Above every impact, which is (10**9 * tf) div (1000 * tf + 20 * m) with m > 0.
IMPACTS = 1_000_000

#: Bytes of terms are letters, digits and all beyond ASCII; the others separate.  A-Z become a-z.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


@dataclass(frozen=True)
class Settings:
    k: int = 50                    # documents returned for each item
    items_a_tile: int = 64
    documents_a_tile: int = 512
    terms_a_tile: int = 4_096      # columns of one product at most
    terms_a_pass: int = 60_000     # terms of the items of one pass over the documents, on average
    exact: int = 1 << 53           # sums in float64 stay below
    tasks: int = 2_048             # tasks that score, each with lists of its own


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of each item's distinct terms (items: item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for few in C.slices(batch):
                found = [sorted({t.decode() for t in terms(x)}) for x in C.raw_texts(few)]
                yield pa.RecordBatch.from_arrays([few.column("item_id"), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])

    return (items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<string>")
            .select("item_id", F.explode("terms").alias("term")).distinct())


def _found(numbers: dict[bytes, int]):
    """Of each text: its number of terms, and the numbers and frequencies of those asked for."""

    def run(batches):
        for batch in batches:
            for few in C.slices(batch):
                sizes, ids, counts = [], [], []
                for text in C.raw_texts(few):
                    words = terms(text)
                    known = [(numbers[t], n) for t, n in Counter(words).items() if t in numbers]
                    sizes.append(len(words))
                    ids.append([i for i, _ in known])
                    counts.append([n for _, n in known])
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id").cast("int64"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "tfs"])

    return run


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Tile:
    """Some items' weights over their own terms: ``parts`` of (term numbers, weights as terms x items)."""

    def __init__(self, names: list[int], rows: list[list[int]], weights: np.ndarray, s: Settings):
        self.items = np.array(names)
        used = np.unique(np.concatenate([np.array(r, np.int64) for r in rows]))
        heaviest = max(1, int(weights[used].max(initial=0)))
        width = max(1, min(s.terms_a_tile, (s.exact - 1) // (heaviest * IMPACTS)))     # products of at most heaviest * IMPACTS
        self.parts = []
        for i in range(0, len(used), width):
            some = used[i:i + width]
            block = np.zeros((len(some), len(rows)))
            for j, r in enumerate(rows):
                mine = np.searchsorted(some, [t for t in r if some[0] <= t <= some[-1]])
                block[mine, j] = weights[some[mine]]
            self.parts.append((some, block))

    def scores(self, docs: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Documents x items, from (row, term, impact) of a tile of ``docs`` documents."""
        total = np.zeros((docs, len(self.items)), np.int64)
        for some, block in self.parts:
            at = np.minimum(np.searchsorted(some, term), len(some) - 1)
            mine = some[at] == term
            dense = np.zeros((docs, len(some)))
            dense[row[mine], at[mine]] = impact[mine]
            total += (dense @ block).astype(np.int64)
        return total


class Best:
    """The first ``k`` of each item's documents by score (highest first) and id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)               # scores below an item's floor cannot be among its best
        self.item, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """``scores``: documents x items from number ``first``."""
        doc, item = np.nonzero(scores >= self.floor[first:first + scores.shape[1]])
        if len(doc):
            self.item = np.concatenate([self.item, item + first])
            self.score = np.concatenate([self.score, scores[doc, item]])
            self.id, self.null = np.concatenate([self.id, ids[doc]]), np.concatenate([self.null, nulls[doc]])
            if len(self.item) > 4 * self.k * len(self.floor):
                self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.id, self.null, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)     # within its item
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.floor[self.item[last]] = self.score[last]
        self.item, self.score, self.id, self.null = self.item[kept], self.score[kept], self.id[kept], self.null[kept]


def _best(tiles: list[Tile], items: int, documents: int, length: int, s: Settings):
    """A task's best documents of each item."""

    def run(batches):
        best = Best(items, s.k)
        for batch in batches:
            for few in C.slices(batch, s.documents_a_tile):
                ids = few.column("doc_id")
                lists, tf = few.column("ids"), few.column("tfs").flatten().to_numpy()
                row = np.repeat(np.arange(few.num_rows), lists.value_lengths().to_numpy())
                term = lists.flatten().to_numpy().astype(np.int64)
                m = 50 + 50 * few.column("n").to_numpy() * documents // length
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
                first = 0
                for t in tiles:
                    best.add(first, t.scores(few.num_rows, row, term, impact), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
                    first += len(t.items)
        best.cut()
        names = np.concatenate([t.items for t in tiles])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[best.item], pa.int64()), pa.array(best.id, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())],
            names=["item", "doc_id", "score"])

    return run


def _one_pass(documents: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """(item, doc_id, score) lists of the items in ``asked`` (item, term), of which there are boundedly many."""
    spark = documents.sparkSession
    rows = asked.select("item", "term").toArrow().to_pydict()
    numbers = {t.encode(): i for i, t in enumerate(sorted(set(rows["term"])))}
    if not numbers:
        return spark.createDataFrame([], "item long, doc_id long, score long")
    sent = spark.sparkContext.broadcast(numbers)
    found = C.stored(documents.select("doc_id", "text").mapInArrow(lambda batches: _found(sent.value)(batches),
                                                                   "doc_id long, n long, ids array<int>, tfs array<long>"), "search-terms")
    n = found.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(numbers), np.int64)
    for r in found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["id"]] = r["df"]
    weights = np.array([weight(int(x), n["documents"]) for x in df], np.int64)
    of: dict[int, list[int]] = {}
    for item, term in zip(rows["item"], rows["term"]):
        of.setdefault(item, []).append(numbers[term.encode()])
    names = sorted(of)
    tiles = [Tile(names[i:i + s.items_a_tile], [of[x] for x in names[i:i + s.items_a_tile]], weights, s)
             for i in range(0, len(names), s.items_a_tile)]
    shared = spark.sparkContext.broadcast(tiles)
    run = lambda batches: _best(shared.value, len(names), n["documents"], max(1, n["length"]), s)(batches)
    return (found.where(F.size("ids") > 0).coalesce(s.tasks).mapInArrow(run, "item long, doc_id long, score long"))


def search(documents: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents (doc_id, text) with a score above 0."""
    C.ship(documents.sparkSession)
    numbered = C.stored(item_terms(items), "search-items")
    total = numbered.count()
    passes = max(1, -(-total // s.terms_a_pass))
    # An item is known by a number of its own while it is searched for.
    names = C.stored(numbered.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "search-names")
    pairs = C.stored(numbered.join(names, numbered["item_id"].eqNullSafe(names["item_id"])).select("item", "term"), "search-item-terms")
    deal = F.pmod(F.xxhash64("item"), F.lit(passes))
    lists = None
    for p in range(passes):
        part = C.stored(_one_pass(documents, pairs.where(deal == p), s), "search-lists")
        lists = part if lists is None else lists.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")

"""Near duplicates by SimHash: exact comparison of fingerprints in tiles.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 hashes
have it set.  Distinct fingerprints are compared once, whatever number of documents
has them: sorted by population count and cut into tiles, two tiles are compared by
exclusive-or and bit counts of all their pairs at once; a pair of tiles is skipped if
their population counts differ by more than the radius (so many bits at least differ)
or if all rows of both are linked already.

Which fingerprints can be in tiles together is dealt by their bits: ``radius`` changed
bits leave one of ``radius + 1`` equal stretches of bits as it is, so each fingerprint
goes to one bucket for each stretch's value, and every link's ends share a bucket.
This loses no link, and there are at most (radius + 1) * 2 ** (64 / (radius + 1))
buckets.  A bucket too large for one task is cut into parts by hash, one task for each
pair of parts, so no task ever holds more than ``task_rows`` fingerprints.

Of the links found, a task returns a forest that connects what they connect: at most
one link for each fingerprint it holds, never all pairs of a group.

Defined cases: a null or empty text, and one without words, has fingerprint zero,
linked like any other; a text of fewer words than a shingle is one shingle; rows are
compared by their fingerprints alone, so rows of one doc_id may be in different
components; a null doc_id takes part, and is a component's id only if all of its ids
are null; repeated rows are returned each; texts are read whole, their hashes counted
in chunks; extra columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tranche.config import SkewParams
from tranche.llm import common as C
from tranche.llm.components import connected_components
from tranche.operators.skew import lookup_join


@dataclass(frozen=True)
class Settings:
    words: int = 3              # of a shingle
    radius: int = 3             # bits that may differ
    seed: int = 42
    tile: int = 512             # fingerprints of a tile
    task_rows: int = 100_000    # fingerprints of one bucket that a task compares
    chunk: int = 65_536         # hashes counted at once
    hot_rows: int = 100_000     # rows of one fingerprint that a task names

    @property
    def stretches(self) -> list[tuple[int, int]]:
        """(first bit, number of bits) of radius + 1 stretches of the 64 bits."""
        ends = [64 * i // (self.radius + 1) for i in range(self.radius + 2)]
        return [(a, b - a) for a, b in zip(ends, ends[1:])]


def fingerprint(text: bytes, s: Settings = Settings()) -> int:
    """The fingerprint of a text in UTF-8, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = min(s.words, len(words)) - 1
    starts, ends = (ends - lengths)[:len(words) - last].tolist(), ends[last:].tolist()
    one, seed, counts = xxhash.xxh64_intdigest, s.seed, np.zeros(64, np.int64)
    for i in range(0, len(starts), s.chunk):
        hashes = np.array([one(line[a:b], seed) for a, b in zip(starts[i:i + s.chunk], ends[i:i + s.chunk])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _prints(s: Settings):
    def run(batches):
        for batch in batches:
            for few in C.slices(batch):
                found = np.array([fingerprint(t, s) for t in C.raw_texts(few)], np.uint64)
                yield pa.RecordBatch.from_arrays([few.column("doc_id").cast("int64"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, fp) of every document (doc_id, text); fp's 64 bits as a long."""
    C.ship(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_prints(s), "doc_id long, fp long")


class Forest:
    """Which rows of a task are linked: ``root`` leads from each to the smallest row it is linked with."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def one(self, a: slice, b: slice) -> bool:
        """Whether all rows of both slices are linked already."""
        first = self.root[a.start]
        return bool((self.root[a] == first).all() and (self.root[b] == first).all())

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            p, q = self.root[x], self.root[y]
            new = p != q
            if not new.any():
                return
            x, y, p, q = x[new], y[new], p[new], q[new]
            np.minimum.at(self.root, np.maximum(p, q), np.minimum(p, q))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def tile_links(bucket: np.ndarray, fps: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among fingerprints of the same bucket (each bucket's rows together)."""
    counts = np.bitwise_count(fps)
    order = np.lexsort((counts, bucket))
    bucket, fps, counts = bucket[order], fps[order], counts[order].astype(np.int64)
    forest, n = Forest(len(fps)), len(fps)
    for i in range(0, n, s.tile):
        a = slice(i, min(i + s.tile, n))
        for j in range(i, n, s.tile):
            b = slice(j, min(j + s.tile, n))
            # Rows after a's are of its last bucket, with growing population counts, or of later buckets.
            if bucket[j] > bucket[a.stop - 1] or (j > i and counts[j] - counts[a.stop - 1] > s.radius):
                break
            if forest.one(a, b):
                continue
            near = np.bitwise_count(fps[a, None] ^ fps[None, b]) <= s.radius
            x, y = np.nonzero(np.triu(near, 1) if i == j else near)
            if len(x):
                forest.link(x + i, y + j)
    child = np.nonzero(forest.root != np.arange(n))[0]
    return fps[forest.root[child]], fps[child]


def _bucket_links(s: Settings, rows_at_once: int = 65_536):
    """Links of a partition's buckets, whose rows come together; several small buckets at once."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(rows):
            a, b = tile_links(rows[0], rows[1], s)
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append((batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            if sum(len(k) for k, _ in held) >= rows_at_once:
                keys, fps = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(keys, keys[-1]))                 # all but the last bucket, which may go on
                if whole:
                    yield flush((keys[:whole], fps[:whole]))
                held = [(keys[whole:], fps[whole:])]
        if held:
            yield flush(tuple(np.concatenate(x) for x in zip(*held)))

    return run


def links(distinct: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp), enough to connect all that are within the radius."""
    C.ship(distinct.sparkSession)
    mask = lambda bits: F.lit((1 << bits) - 1).cast("long")
    keys = F.array(*[F.struct(F.lit(i).alias("stretch"), F.shiftrightunsigned("fp", first).bitwiseAND(mask(bits)).alias("value"))
                     for i, (first, bits) in enumerate(s.stretches)])
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.stretch", "k.value")
    key = ["stretch", "value"]
    # Buckets too large for a task: no more rows than there are values of a stretch.
    large = C.stored(dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.task_rows)
                     .select(*key, F.ceil(2 * F.col("n") / s.task_rows).cast("int").alias("parts")), "large-buckets")
    if large.limit(1).count() == 0:
        tasks = dealt.withColumn("part", F.lit(0)).withColumn("other", F.lit(0))
    else:
        marked = dealt.join(F.broadcast(large), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pairs = (marked.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .where((F.col("parts") == 1) | (F.col("mine") != F.col("with"))))     # a part meets itself beside any other
        tasks = pairs.select("fp", *key, F.least("mine", "with").alias("part"), F.greatest("mine", "with").alias("other"))
    bucket = [*key, "part", "other"]
    rows = (tasks.repartition(*bucket).select(F.xxhash64(*bucket).alias("bucket"), "fp").sortWithinPartitions("bucket"))
    return rows.mapInArrow(_bucket_links(s), "a long, b long")


def near_duplicates(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document (doc_id, text): doc_id, fp, fingerprint (16 hex digits), component_id."""
    prints = C.stored(fingerprints(documents, s).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    classes = C.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    found = connected_components(C.stored(links(classes.select("fp"), s), "fingerprint-links"))
    parts = C.stored(classes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left")
                     .select("fp", "n", "first", F.coalesce("component", "fp").alias("component")), "fingerprint-components")
    # Components' ids: counted by component with partial sums, then named for each fingerprint.
    ids = parts.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    skew = SkewParams(rows_per_bucket=s.hot_rows)
    named = lookup_join(parts, ids.where("members > 1").drop("members"), "component", ["fp"], skew)
    named = C.stored(named.select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "fingerprint-names")
    hot = named.where(F.col("n") >= s.hot_rows).select("fp", F.col("n").alias("_n"))
    return (lookup_join(prints, named.select("fp", "component_id"), "fp", ["row"], skew, hot=hot)
            .select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))

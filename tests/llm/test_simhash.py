"""SimHash against brute force: fingerprints bit by bit, links by all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tranche.llm import simhash as S
from tranche.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    """Smallest id reachable of each row, by all pairs of distinct prints."""
    distinct = sorted(set(prints))
    up = {p: p for p in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                up[root(b)] = root(a)
    least = {}
    for p, i in zip(prints, ids):
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    return [least.get(root(p)) for p in prints]


def expected(rows):
    prints = [brute_print(t) for _, t in rows]
    comps = components(prints, [i for i, _ in rows])
    return sorted([(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, comps)], key=str)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in QUERIES["op11_simhash_dedup"](spark, SF).collect()], key=str)
    assert got == expected(rows) and any(i != c for i, _, c in got)


def test_odd_rows(spark, odd_documents, no_documents):
    """Nulls, no words, repeated rows, a very long text, clashing columns, no rows."""
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(odd_documents).collect()]
    assert sorted(got, key=str) == expected(rows)
    assert S.near_duplicates(no_documents).count() == 0


def test_chunks_change_nothing():
    text = " ".join(random.Random(4).choices(["ab", "C", "dé", "long-word", "x" * 40], k=5000)).encode()
    assert S.fingerprint(text) == S.fingerprint(text, S.Settings(chunk=7)) == brute_print(text.decode())


def clustered(seed, n):
    """Fingerprints of which many lie within a few bits of one another, some sharing a stretch of bits."""
    rng = random.Random(seed)
    out = {0, 7, (1 << 64) - 1}
    centres = [rng.getrandbits(64) for _ in range(6)] + [rng.getrandbits(48) for _ in range(4)]
    while len(out) < n:
        p = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize("settings", [S.Settings(), S.Settings(tile=3), S.Settings(task_rows=20, tile=4), S.Settings(hot_rows=2, task_rows=50)])
def test_links_against_all_pairs(spark, settings):
    """Tiles, buckets cut into parts, and hot fingerprints connect what all pairs connect."""
    prints = clustered(settings.tile, 700)
    signed = [int(x) for x in np.array(prints, np.uint64).view(np.int64)]
    found = S.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3), settings).collect()
    up = {p: p for p in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in found:
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 64 and r["a"] != r["b"]
        up[root(r["b"])] = root(r["a"])
    got = {}
    for p, s in zip(prints, signed):
        got.setdefault(root(s), set()).add(p)
    comps = {}
    for p, c in zip(prints, components(prints, range(len(prints)))):
        comps.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, comps.values()))
    assert len(found) <= 4 * len(prints) * (1 if settings.task_rows > 700 else 100)


def test_tiles_beyond_the_radius_are_skipped(monkeypatch):
    """Tiles whose population counts differ by more than the radius are never compared."""
    rng = np.random.default_rng(1)
    low, high = (np.unique(np.packbits(rng.random((600, 64)) < p, axis=1).view(np.uint64).ravel()) for p in (0.1, 0.9))
    fps, shapes, count = np.concatenate([low, high]), [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: shapes.append(x.shape) or count(x))
    S.tile_links(np.zeros(len(fps), np.int64), fps, S.Settings(tile=16))
    compared = sum(1 for x in shapes if len(x) == 2)
    tiles = -(-len(fps) // 16)
    assert 0 < compared < 0.45 * tiles * (tiles + 1) / 2


def test_one_fingerprint_in_most_rows(spark):
    """A hot fingerprint's rows are named by salted parts, and all of them."""
    docs = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, F.lit("the same words in most rows")).otherwise(F.concat(F.lit("row "), "id")).alias("text"))
    got = S.near_duplicates(docs.withColumnRenamed("id", "doc_id"), S.Settings(hot_rows=100)).collect()
    assert len(got) == 4000 and {r["component_id"] for r in got if r["doc_id"] % 3} == {1}

"""Merkle manifest against a plain recomputation in memory."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tranche.llm import merkle as M
from tranche.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, add=0):
    row = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + add, r["text"]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + arity]) for i in range(0, len(last), arity)])
    return levels


def siblings(levels, i, arity):
    out = []
    for nodes in levels[:-1]:
        lo = i // arity * arity
        out.append((i - lo, nodes[lo:i] + nodes[i + 1:lo + arity]))
        i //= arity
    return out


def brute(rows, tampered, arity=2):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        grown[lang] = grow([leaf(r) for r in trees[lang]], arity)
    top = grow([grown[lang][-1][0] for lang in order], arity)
    root, out = top[-1][0], []
    for j, lang in enumerate(order):
        for i, r in enumerate(trees[lang]):
            path = siblings(grown[lang], i, arity) + siblings(top, j, arity)
            node = leaf(r, 1 if tampered(r["doc_id"]) else 0)
            for place, others in path:
                node = h(*others[:place], node, *others[place:])
            out.append((r["doc_id"], leaf(r), grown[lang][-1][0], root, h(*(d for _, o in path for d in o)), node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = found(QUERIES["op12_merkle_manifest"](spark, SF))
    assert got == brute(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 0)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.fixture(scope="module")
def odd_rows(spark):
    rows = [(i % 23, "s", lang, i if i % 5 else None, f"text {i % 3}", "clash")
            for lang, n in (("en", 41), (None, 9), ("", 2), ("é", 1), ("zz", 8)) for i in range(n)]
    rows += [(None, None, None, None, None, "x")] * 3 + [(7, None, "de", 4, "same", "x")] * 30 + [(8, "s", "de", 9, "long " * 50_000, "y")]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)


@pytest.mark.parametrize("settings", [M.Settings(), M.Settings(levels=1), M.Settings(levels=2), M.Settings(arity=3, levels=2)])
def test_odd_rows_any_arity_and_segments(spark, odd_rows, settings):
    """Null fields, ids and languages; copies across segments; clashing columns; a very long text."""
    tampered = lambda i: i is not None and i % 2 == 0
    got = M.manifest(odd_rows, F.col("doc_id") % 2 == 0, settings, whole=True)
    assert found(got) == brute([r.asDict() for r in odd_rows.collect()], tampered, settings.arity)
    for r in got.collect():                             # paths are whole proofs
        steps = [(x["place"], x["others"]) for x in r["path"]]
        assert M.fold(r["leaf"], steps) == r["root"]
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r["lang"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_one_row_and_empty_table(spark, odd_rows):
    none = M.manifest(odd_rows.limit(0), F.lit(True))
    assert none.count() == 0 and set(COLUMNS) <= set(none.columns)
    one = spark.createDataFrame([(5, "s", "en", 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = M.manifest(one, F.lit(False)).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == h("") and r["verified"]

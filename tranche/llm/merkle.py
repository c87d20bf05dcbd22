"""Merkle manifest of a dataset: content-addressed records, proofs by descent from the root.

A leaf is the sha256 of a row's fields.  The leaves of each language, in order of
doc_id, are the bottom of a tree in which every ``arity`` consecutive nodes make the
next level's node; the languages' roots, in order of language, make one more tree.

* Building: a tree is cut into segments of ``levels`` levels.  A segment stands over
  at most ``arity ** levels`` consecutive nodes and is hashed in one group of rows; it
  stores one record, digest to children, for each of its nodes, and its top is a node
  of the segment above.  A hot language is only more segments.
* Requests: each leaf asks for its siblings.  Requests descend from the root: in a
  segment, the digits of a node's rank in base ``arity`` say which child to take, its
  digest is the next record's key, and the children not taken are collected.  What was
  collected above a segment is passed on to its nodes as one path; at the leaf the
  path's steps are reversed, so that they lead from the leaf to the root.

Every group of rows holds one segment's nodes and records, so its size is bounded
whatever the data.  All records and ranks are tables in the shared folder.

Defined cases: a null field counts as ``-``; a null language and an empty one are
different languages, the null one first; a null doc_id comes before all others and is
never tampered with; rows of one doc_id are ordered by their leaf; equal rows are
leaves of their own next to one another (counted before they are shuffled, so their
number does not matter); texts are hashed whole, however long; extra columns are never
read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tranche.llm import common as C

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Settings:
    arity: int = 2       # children of a node
    levels: int = 12     # levels of a segment


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts one after another."""
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int, arity: int) -> int:
    """Levels above ``n`` nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


def leaf_of(**changed: Column) -> Column:
    """Digest of a row's fields; each is ``-`` if null, else its byte count, ``:`` and its value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(documents: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, leaf, given): given is the leaf of the row with one more character where ``tampered`` holds."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))           # never null, in the languages' order
    other = F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), leaf_of(n_chars=F.try_add(F.col("n_chars"), F.lit(1))))
    return (documents.select(*FIELDS).select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("leaf"),
                                             other.alias("other"))
            .select("tree", "doc_id", "leaf", F.coalesce("other", "leaf").alias("given")))


def _counted(batches):
    """Rows of a sorted partition with the partition's number and, for each tree, the copies before them in it."""
    pid, tree, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        starts = []
        for t, n in zip(batch.column("tree").to_pylist(), batch.column("copies").to_pylist()):
            if t != tree:
                tree, before = t, 0
            starts.append(before)
            before += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * len(starts), pa.int32()), pa.array(starts, pa.int64())],
                                         names=[*batch.schema.names, "pid", "before"])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Distinct ``rows`` (with tree) in ``order`` within their tree: copies, rank of the first copy, n (leaves of the tree).

    One shuffle by ranges; ranks come from the counts of each range, so no task sees a whole tree.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    keys = ["tree", *order]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema)
    placed = C.stored(counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
                      .mapInArrow(_counted, f"{kind}, pid int, before long"), "merkle-places")
    parts = C.stored(placed.groupBy("tree", "pid").agg(F.sum("copies").alias("part")), "merkle-parts")
    tree = Window.partitionBy("tree")                  # a row for each range that a tree reaches: at most one a partition
    first = parts.select("tree", "pid", F.sum("part").over(tree).alias("n"),
                         (F.sum("part").over(tree.orderBy("pid")) - F.col("part")).alias("first"))
    return placed.join(first, ["tree", "pid"]).withColumn("rank", F.col("first") + F.col("before")).drop("pid", "before", "first")


def _in_segments(rows: DataFrame, s: Settings) -> DataFrame:
    """Rows (tree, rank, n, copies, ...) once for each segment that their copies reach."""
    width = F.lit(s.arity ** s.levels).cast("long")
    first, last = F.expr(f"rank div {s.arity ** s.levels}"), F.expr(f"(rank + copies - 1) div {s.arity ** s.levels}")
    return (rows.withColumn("segment", F.explode(F.sequence(first, last)))
            .withColumn("start", F.greatest(F.col("rank"), F.col("segment") * width))
            .withColumn("copies", F.least(F.col("rank") + F.col("copies"), (F.col("segment") + 1) * width) - F.col("start"))
            .withColumn("rank", F.col("start")).drop("start"))


def _build(s: Settings, name: str):
    """Records of one segment: digest to children, and its top without children."""

    def run(key, table):
        rows = sorted(zip(table["rank"].to_pylist(), table["copies"].to_pylist(), table[name].to_pylist()))
        nodes = [d for _, copies, d in rows for _ in range(copies)]
        records = {}
        for _ in range(min(s.levels, height(table["n"][0].as_py(), s.arity))):
            runs = [nodes[i:i + s.arity] for i in range(0, len(nodes), s.arity)]
            nodes = [digest(*r) for r in runs]
            records.update(zip(nodes, runs))
        (top,) = nodes
        tree, segment = (k.as_py() for k in key)
        m = len(records) + 1
        return pa.table([pa.array([tree] * m, pa.string()), pa.array([segment] * m, pa.int64()), pa.array([table["n"][0].as_py()] * m, pa.int64()),
                         pa.array([*records, top], pa.string()), pa.array([*records.values(), None], pa.list_(pa.string()))],
                        names=["tree", "segment", "n", "digest", "children"])

    return run


RECORDS = "tree string, segment long, n long, digest string, children array<string>"


def build(rows: DataFrame, name: str, most: int, s: Settings) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Stages of (nodes, records) from the bottom up, and (tree, digest) of every tree's root.

    ``rows``: tree, rank, copies, n and the node's digest as ``name``; ``most``: nodes of the largest tree.
    """
    stages, width = [], s.arity ** s.levels
    while True:
        nodes = _in_segments(rows, s)
        records = C.stored(nodes.groupBy("tree", "segment").applyInArrow(_build(s, name), RECORDS), "merkle-records")
        stages.append((nodes, records))
        tops = records.where("children IS NULL")
        if most <= width:
            return stages, tops.select("tree", "digest")
        rows = tops.select("tree", F.col("segment").alias("rank"), F.lit(1).cast("long").alias("copies"),
                           F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("digest").alias("node"))
        most, name = -(-most // width), "node"


_STEP = pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])
_PATH = "array<struct<place: int, others: array<string>>>"


def fold(leaf: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and the steps from it upwards (its place among the run, the run's others) give."""
    for place, others in steps:
        leaf = digest(*others[:place], leaf, *others[place:])
    return leaf


def _descend(s: Settings):
    """Paths, from the root downwards, of the nodes of one segment: what came from above, and the children not taken in it."""

    def run(requests, records):
        children, path, top, subroot = {}, [], None, None
        for r in records.to_pylist():
            if r["children"] is not None:
                children[r["digest"]] = r["children"]
            else:
                top, subroot, path = r["digest"], r["subroot"], [(x["place"], x["others"]) for x in r["above"]]
        if not requests.num_rows:
            return
        depth = min(s.levels, height(requests["n"][0].as_py(), s.arity))
        first = requests["segment"][0].as_py() * s.arity ** s.levels
        for row in requests.to_pylist():
            for rank in range(row["rank"], row["rank"] + row["copies"]):
                node, steps, here = top, [*path], rank - first
                for level in reversed(range(depth)):
                    place = here // s.arity ** level % s.arity
                    kids = children[node]
                    steps.append((place, kids[:place] + kids[place + 1:]))
                    node = kids[place]
                yield row, rank, node, subroot, steps

    return run


def _told(steps: list) -> list[dict]:
    return [{"place": place, "others": others} for place, others in steps]


def _tables(kinds: dict[str, tuple[str, pa.DataType]], rows):
    """A function of (requests, records) that returns ``rows`` of them as a table, and its kind for Spark."""

    def run(requests, records):
        out = list(rows(requests, records))
        return pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds.values())], names=list(kinds))

    return run, ", ".join(f"{name} {kind}" for name, (kind, _) in kinds.items())


_TEXT, _LONG, _STEPS = ("string", pa.string()), ("long", pa.int64()), (_PATH, pa.list_(_STEP))


def _to_segments(s: Settings):
    """For each node its path as what comes from above for the segment of which it is the top."""
    found = _descend(s)
    return _tables({"tree": _TEXT, "segment": _LONG, "subroot": _TEXT, "above": _STEPS},
                   lambda a, b: ((row["tree"], rank, subroot, _told(steps)) for row, rank, _, subroot, steps in found(a, b)))


def _to_subroots(s: Settings):
    """The same for the languages' roots, each the top of its own tree."""
    found = _descend(s)
    return _tables({"tree": _TEXT, "segment": _LONG, "subroot": _TEXT, "above": _STEPS},
                   lambda a, b: ((row["language"], 0, node, _told(steps)) for row, _, node, _, steps in found(a, b)))


def _to_leaves(s: Settings, whole: bool):
    """What a leaf's request returns, its path reversed; ``whole``: with the path itself."""
    found = _descend(s)

    def rows(requests, records):
        for row, rank, node, subroot, steps in found(requests, records):
            if node != row["leaf"]:
                raise ValueError(f"the records lead to {node}, not to the leaf {row['leaf']}")
            steps.reverse()
            yield (row["tree"], row["doc_id"], rank, node, subroot, digest(*(d for _, others in steps for d in others)),
                   fold(row["given"], steps), _told(steps) if whole else None)

    return _tables({"tree": _TEXT, "doc_id": _LONG, "rank": _LONG, "leaf": _TEXT, "subroot": _TEXT, "proof_sha256": _TEXT,
                    "folded_root": _TEXT, "path": _STEPS}, rows)


def _requests(stage, above: DataFrame, then) -> DataFrame:
    """A stage's requests met by its records; ``above``: (tree, segment, subroot, above) of each segment's top."""
    nodes, records = stage
    inner = records.where("children IS NOT NULL").select("tree", "segment", "digest", "children")
    tops = records.where("children IS NULL").join(above, ["tree", "segment"]).select("tree", "segment", "digest", "children", "subroot", "above")
    run, kind = then
    return (nodes.groupBy("tree", "segment").cogroup(inner.unionByName(tops, allowMissingColumns=True).groupBy("tree", "segment"))
            .applyInArrow(run, kind))


def _descended(stages, above: DataFrame, s: Settings, last) -> DataFrame:
    """Requests of all stages, from the root's segment (whose path is ``above``) down to the bottom."""
    for stage in reversed(stages[1:]):
        above = C.stored(_requests(stage, above, _to_segments(s)), "merkle-paths")
    return _requests(stages[0], above, last)


def manifest(documents: DataFrame, tampered: Column, s: Settings = Settings(), whole: bool = False) -> DataFrame:
    """One row per document: doc_id, lang, rank, leaf, subroot, root, proof_sha256, folded_root, verified and (if ``whole``) path.

    ``proof_sha256`` is the digest of the siblings from the leaf to the root;
    ``folded_root`` is recomputed from the leaf as given, which differs from the
    recorded one where ``tampered`` holds; ``verified`` tells whether it is the root.
    """
    C.ship(documents.sparkSession)
    rows = C.stored(ranked(leaves(documents, tampered), ["doc_id", "leaf", "given"]), "merkle-leaves")
    stages, subroots = build(rows, "leaf", rows.agg(F.max("n")).first()[0] or 0, s)

    # The languages' tree: its leaves are the subroots.
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("language"), F.col("digest").alias("subroot"))
    tops = C.stored(ranked(tops, ["language", "subroot"]), "merkle-subroots")
    upper, roots = build(tops, "subroot", tops.agg(F.max("n")).first()[0] or 0, s)
    root = F.lit(r["digest"] if (r := roots.first()) else None).cast("string")
    start = roots.select("tree", F.lit(0).cast("long").alias("segment"), F.lit(None).cast("string").alias("subroot"), F.array().cast(_PATH).alias("above"))
    above = C.stored(_descended(upper, start, s, _to_subroots(s)), "merkle-paths")

    out = (_descended(stages, above, s, _to_leaves(s, whole)).withColumn("root", root)
           .withColumn("verified", F.col("folded_root") == F.col("root"))
           .withColumn("lang", F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))))
    return out.select("doc_id", "lang", "rank", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["path"] if whole else []))

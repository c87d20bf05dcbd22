"""URL filter: given rules, and templates learned from labelled URLs.

Paths of a host form a tree of segments.  Level by level, variable segments become
wildcards: digits always, and siblings with few labels or whose labelled share of bad
URLs does not differ from the rest of the node's (two-proportion test), which are so
merged into one branch; how small a part of its node a branch is plays no role.
Beyond ``depth`` levels only nodes grow that can still be split (several shapes, good
and bad labels, enough of them for two branches); of the others, what follows is one
wildcard.  The paths' lengths set no limit.  A
template's purity is its share of bad labelled URLs, smoothed towards its parent's
(the root's: towards that of all hosts); templates that reach a limit are rejected.

The tree is built from counts per host and shape, pre-aggregated on the map side.  A
host whose paths differ only in digits is then a few rows; one of worded slugs is as
many as it has paths, all under one node.  A node's figures are therefore broadcast
to its branches, or beyond a bound met with the rows of large nodes salted, and a
branch that is merged takes its figures from the node's less those of the branches
that stay: no step gathers a node's rows.  DataFrame functions only.

Defined cases: a null url, or one without ``://``, has an empty host and path; such
URLs share the tree of the empty host; null labels are no labels; repeated rows get
equal verdicts; without labels nothing is rejected; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tranche.config import SkewParams
from tranche.llm import common as C
from tranche.operators.skew import lookup_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    depth: int = 4                   # segments named one by one; deeper ones only where a node can be split
    min_labels: int = 8              # a branch with fewer labels is not told apart
    z: float = 2.58                  # of the two-proportion test
    smoothing: float = 8.0           # labels that the parent's purity counts for
    purity: float = 0.6              # smoothed share of bad URLs that rejects a template
    broadcast_shapes: int = 200_000  # more shapes than this are joined by shuffling,
    broadcast_chars: int = 20_000_000  # as are shapes with more characters than this
    broadcast_nodes: int = 100_000   # nodes of one level that are sent to all tasks; more meet salted rows
    node_rows: int = 100_000         # rows of one node that go to one task then


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substr(url, F.instr(url, F.lit("://")) + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.substr(url, F.instr(url, F.lit("://")) + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):       # later ones come first in the chain
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path's segments with digits as wildcards."""
    parts = F.split(F.regexp_replace(path, r"[0-9]+", "*"), "/")
    return F.slice(parts, 2, F.size(parts))


def _with_nodes(rows: DataFrame, figures: DataFrame, s: Settings, row_id: str) -> DataFrame:
    """``rows`` (host, template, ...) with the figures of their nodes (one row each; null where there is none)."""
    figures = C.stored(figures, "url-nodes")
    if figures.limit(s.broadcast_nodes + 1).count() <= s.broadcast_nodes:
        return rows.join(F.broadcast(figures), ["host", "template"], "left")
    node = F.struct("host", "template")
    return lookup_join(rows.withColumn("node", node), figures.withColumn("node", node).drop("host", "template"), "node", [row_id],
                       SkewParams(rows_per_bucket=s.node_rows)).drop("node")


def templates(labelled: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, shape, template, purity, labels) from URLs (host, path, bad: 1, 0 or null)."""
    shapes = C.stored(labelled.select("host", shape_of(F.col("path")).alias("shape"), "bad")
                      .groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labels"),
                                                    F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")), "url-shapes")
    every = shapes.agg(F.sum("bad").alias("b"), F.sum("labels").alias("l")).first()
    prior = (every["b"] + 1.0) / (every["l"] + 2.0) if every["l"] else 0.0
    smooth = lambda bad, labels, base: (bad + s.smoothing * base) / (labels + s.smoothing)
    root = (shapes.groupBy("host").agg(F.sum("bad").alias("b"), F.sum("labels").alias("l"))
            .select("host", F.lit("").alias("template"), smooth(F.col("b"), F.col("l"), F.lit(prior)).alias("purity"), F.col("l").alias("at_labels")))
    tree = C.stored(_with_nodes(shapes.withColumn("template", F.lit("")), root, s, "shape").withColumn("closed", F.lit(False)), "url-tree")
    d = -1
    while True:
        d += 1
        goes_on = ~F.col("closed") & (F.size("shape") > d)
        if not tree.where(goes_on).limit(1).count():
            break
        opened = F.lit(True)
        if d >= s.depth:
            alike = F.xxhash64("shape")
            can_split = ((F.col("nl") >= 2 * s.min_labels) & (F.col("nb") > 0) & (F.col("nb") < F.col("nl")) & (F.col("lo") < F.col("hi")))
            nodes = (tree.where(goes_on).groupBy("host", "template")
                     .agg(F.sum("labels").alias("nl"), F.sum("bad").alias("nb"), F.min(alike).alias("lo"), F.max(alike).alias("hi"))
                     .where(can_split).select("host", "template", F.lit(True).alias("opened")))
            tree = _with_nodes(tree, nodes, s, "shape")
            opened = F.coalesce("opened", F.lit(False))
        tree = (tree.withColumn("seg", F.when(goes_on, F.when(opened, F.get("shape", F.lit(d))).otherwise(F.lit("**"))))
                .withColumn("closed", F.col("closed") | ~opened))
        child = C.stored(tree.groupBy("host", "template", "seg").agg(F.sum("labels").alias("l"), F.sum("bad").alias("b")), "url-branches")
        node = child.groupBy("host", "template").agg(F.count("seg").alias("children"), F.sum("l").alias("nl"), F.sum("b").alias("nb"))
        both = _with_nodes(child, node, s, "seg")
        others, pooled = F.col("nl") - F.col("l"), F.col("nb") / F.col("nl")
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / others))
        differs = F.when((F.col("l") >= s.min_labels) & (others >= s.min_labels) & (F.col("nb") > 0) & (F.col("nb") < F.col("nl")),
                         F.abs(F.col("b") / F.col("l") - (F.col("nb") - F.col("b")) / others) > s.z * error).otherwise(F.lit(False))
        both = C.stored(both.withColumn("merged", (F.col("children") > 1) & ~differs & F.col("seg").isNotNull()), "url-marked")
        # What the merged branches of a node are together; a branch that stays is itself.
        whole = both.where("merged").groupBy("host", "template").agg(F.sum("l").alias("ml"), F.sum("b").alias("mb"))
        name = F.when(F.col("seg").isNull(), F.lit("")).when(F.col("merged"), F.lit("/*")).otherwise(F.concat(F.lit("/"), F.col("seg")))
        # A segment that is a wildcard by itself bears the merged branches' name, and is counted with them.
        alike = F.col("merged") | (F.col("seg") == "*")
        stars = both.where(~F.col("merged") & (F.col("seg") == "*")).select("host", "template", F.col("l").alias("sl"), F.col("b").alias("sb"))
        named = _with_nodes(_with_nodes(both, whole, s, "seg"), stars, s, "seg")
        zero = F.lit(0)
        named = named.select("host", "template", F.col("seg").alias("s2"), name.alias("name"),
                             F.when(alike, F.coalesce("ml", zero) + F.coalesce("sl", zero)).otherwise(F.col("l")).alias("l"),
                             F.when(alike, F.coalesce("mb", zero) + F.coalesce("sb", zero)).otherwise(F.col("b")).alias("b"))
        t = tree.alias("t").join(named.alias("m"), (F.col("t.host") == F.col("m.host")) & (F.col("t.template") == F.col("m.template"))
                                 & F.col("t.seg").eqNullSafe(F.col("m.s2")))
        on = F.col("t.seg").isNotNull()                  # a path that ends here keeps its own figures
        tree = C.stored(t.select("t.host", "shape", "n", "labels", "bad", "closed", F.concat("t.template", "name").alias("template"),
                                 F.when(on, smooth(F.col("m.b"), F.col("m.l"), F.col("purity"))).otherwise(F.col("purity")).alias("purity"),
                                 F.when(on, F.col("m.l")).otherwise(F.col("at_labels")).alias("at_labels")), "url-tree")
    return tree.select("host", "shape", "template", "purity", F.col("at_labels").alias("labels"))


def judge(urls: DataFrame, rules: list[Rule], s: Settings = Settings()) -> DataFrame:
    """One row per URL (page_id, url, bad): page_id, host, path, rule, verdict, template, purity.

    ``bad`` labels some of the URLs (1 or 0; null: not labelled).
    """
    parsed = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad"))
    learned = C.stored(templates(parsed, s), "url-templates")
    size = learned.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.array_join("shape", "/"))), F.lit(0)).alias("chars")).first()
    near = F.broadcast(learned) if size["n"] <= s.broadcast_shapes and size["chars"] <= s.broadcast_chars else learned
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = parsed.withColumn("rule", rule).withColumn("said", verdict).withColumn("shape", shape_of(F.col("path")))
    by_method = F.when((F.col("labels") >= s.min_labels) & (F.col("purity") >= s.purity), F.lit("block")).otherwise(F.lit("allow"))
    return named.join(near, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", by_method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))

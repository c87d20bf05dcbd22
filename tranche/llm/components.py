"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tranche.llm import common as C


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): component is the smallest node reachable.

    Each round looks one step up from a node's label and from its neighbours' labels, and the least
    of these goes to the node and to its label's node, so whole trees are hooked to one another and
    few rounds do for long paths too.  Rounds start from files in the shared folder; only a count of
    changes reaches the driver.
    """
    both = C.stored(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = C.stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")),
                      "labels")
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        known = labels.join(up, "component").select("node", "component", "next")
        near = both.join(known.select(F.col("node").alias("b"), "next"), "b").groupBy("a").agg(F.min("next").alias("near"))
        step = known.join(near.withColumnRenamed("a", "node"), "node")
        own = F.struct("node", F.col("component").alias("old"), F.least("next", "near").alias("component"))
        hook = F.struct(F.col("component").alias("node"), F.lit(None).cast("long").alias("old"), F.col("near").alias("component"))
        new = C.stored(step.select(F.explode(F.array(own, hook)).alias("r")).groupBy("r.node")
                       .agg(F.max("r.old").alias("old"), F.min("r.component").alias("component")), "labels")
        if new.where("component != old").limit(1).count() == 0:
            return new.select("node", "component")
        labels = new.select("node", "component")

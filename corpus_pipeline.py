"""The corpus pipeline: toxicity, quality rules, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all
their columns; the last returns the pieces of packed sequences.  Null or empty texts,
repeated rows, empty tables and extra columns are handled as the operators of
``tranche.llm`` define; where this file adds something, the stage says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tranche.llm import common as C, decontam, ngram_join, packing, quality_rules, toxicity

#: Removed ids are broadcast up to this many; more are joined by shuffling.
BROADCAST_IDS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores below the threshold."""
    labels = C.table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, F.lit(True)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one with the smallest id, rows without an id last.

    Rows are told apart by a hash of id and text, so ids may be null or shared by
    unlike texts.  Of rows equal in both, the one whose other columns hash lowest
    stays.  Rows without shingles are like no other and all stay.
    """
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = C.stored(ngram_join.near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"))
                     .where("n_shingles > 0").groupBy(F.col("doc_id").alias("__row"), "component_id").agg(F.count(F.lit(1)).alias("rows")), "components")
    ids = keyed.groupBy("__row").agg(F.min("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("first")
    kept = C.stored(found.join(ids, "__row").groupBy("component_id").agg(first).select(F.col("first.__row").alias("__row")), "kept")
    gone = _near(C.stored(found.join(kept, "__row", "left_anti").select("__row").distinct(), "duplicates"))
    again = _near(C.stored(found.join(kept, "__row", "left_semi").where("rows > 1").select("__row"), "repeated-rows"))
    left = keyed.join(gone, "__row", "left_anti")
    others = [c.name for c in docs.schema if "map<" not in c.dataType.simpleString()]
    one = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*others)).alias("one")
    once = left.join(again, "__row", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(again, "__row", "left_semi").groupBy("__row").agg(one).select("one.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.drop_contaminated(docs, C.table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences; workers keep no parts for later stages."""
    return packing.pack(docs, s=packing.Settings(keep=False))


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_good), ("ngram_join", one_of_each_group),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Sinks.  Derived tables are written as parquet and read back, which
cuts lineage (a lost executor re-reads finished files instead of recomputing
upstream stages).  Paths must be on storage every executor sees: by default
they live under the session's ``spark.checkpoint.dir``.

Layouts:

* plain: rows sorted within files by company, so that a literal key prunes row groups;
* bucketed by company (``write_bucketed``): joins and groupings on the company need no
  exchange, and a literal company reads one bucket, in it the row groups whose range
  and bloom filter can hold the key;
* partitioned (``partition_by``): a filter on the partition column reads its folders
  only; with ``dynamic`` a write replaces the partitions it has rows for and no others.

Every write counts its rows, its rows without a company and its money on the way
(``observe``), so that a build's checks cost no other pass.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

KEY = "cnpj_raiz"


class Counted:
    """What an action on an observed frame counted on the way."""

    def __init__(self, **of_nothing):
        self.seen, self.of_nothing = Observation(), of_nothing

    def get(self) -> dict:
        """The counts, once the action is over; those of no rows if the frame turned out empty before they were taken
        (Spark then drops the counting from the plan and has no row of counts to give)."""
        try:
            return {k: self.of_nothing[k] if v is None else v for k, v in self.seen.get.items()} or self.of_nothing
        except Py4JJavaError as e:
            if "AssertionError" not in str(e.java_exception):
                raise
            return self.of_nothing


def observed(df: DataFrame) -> tuple[DataFrame, Counted]:
    """``df`` and what a write of it will have counted: rows, rows without a company, sum of the first money column."""
    money = [f.name for f in df.schema if isinstance(f.dataType, DecimalType)][:1]
    seen = Counted(rows=0, **({"null_keys": 0} if KEY in df.columns else {}), **{f"sum_{c}": None for c in money})
    return df.observe(seen.seen, F.count(F.lit(1)).alias("rows"),
                      *([F.count_if(F.col(KEY).isNull()).alias("null_keys")] if KEY in df.columns else []),
                      *[F.sum(c).cast("string").alias(f"sum_{c}") for c in money]), seen


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_within: list[str] | None = None, dynamic: bool = False) -> None:
    """Overwrite ``path`` with ``df``; optional partition columns, and rows
    sorted within files by ``sort_within`` so that filters by a literal
    key can prune row groups (semi-joins do not)."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A written table with the columns in the order they were written in (no footer-inference job)."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_and_reload(df: DataFrame, path: str, sort_within: list[str] | None = None,
                     partition_by: list[str] | None = None) -> DataFrame:
    sort_cols = sort_within
    if sort_cols is None and KEY in df.columns:
        sort_cols = [KEY]
    write_table(df, path, partition_by, sort_within=sort_cols)
    return read_table(df.sparkSession, path, df.schema)


def _declare(spark: SparkSession, path: str, schema: StructType, buckets: int, options: dict[str, str] | None = None) -> str:
    """Make the folder ``path`` known to this session as a table bucketed and sorted by company; its name."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    told = {f"parquet.bloom.filter.enabled#{KEY}": "true", f"parquet.bloom.filter.expected.ndv#{KEY}": "200000"} | (options or {})
    said = ", ".join(f"'{k}' '{v}'" for k, v in told.items())
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS ({said}) "
              f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return name


def open_bucketed(spark: SparkSession, path: str, schema: StructType, buckets: int) -> DataFrame:
    """A table that ``write_bucketed`` wrote, perhaps in another session."""
    return spark.table(_declare(spark, path, schema, buckets))


def write_bucketed(df: DataFrame, path: str, buckets: int, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as ``buckets`` files, each with the rows of some companies, sorted by company; read back as a bucketed table.

    For rows with a key, none of them hot: a bucket is one task's work.
    """
    spark = df.sparkSession
    name = _declare(spark, path, df.schema, buckets, options)
    df.repartition(buckets, KEY).write.insertInto(name, overwrite=True)
    return spark.table(name)


@dataclass(frozen=True)
class Parts:
    """A stored table of agreements in two parts: ``keyed`` is bucketed by company; ``rest`` holds
    the rows of hot companies and those without a company, spread evenly (None: there are none)."""

    keyed: DataFrame
    rest: DataFrame | None

    @property
    def frame(self) -> DataFrame:
        return self.keyed if self.rest is None else self.keyed.unionByName(self.rest)

"""S1 scan rules on a hand-made parquet fixture: declared schema, projection,
NaN -> null at the scan (D-10)."""

import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tranche.sources.tables import MissingColumns, read_table


def test_nan_becomes_null_and_projection(spark, tmp_path):
    t = pa.table({"c_custkey": pa.array([1, 2, 3], pa.int64()), "c_name": ["a", "b", "c"],
                  "c_nationkey": pa.array([0, 1, 2], pa.int32()),
                  "c_acctbal": [1.0, math.nan, -2.0], "c_mktsegment": ["X", "Y", "Z"]})
    pq.write_table(t, str(tmp_path / "customer.parquet"))
    df = read_table(spark, str(tmp_path), "customer", ["c_custkey", "c_acctbal"])
    assert df.columns == ["c_custkey", "c_acctbal"]
    rows = {r.c_custkey: r.c_acctbal for r in df.collect()}
    assert rows == {1: 1.0, 2: None, 3: -2.0}
    # a NaN would compare true to >= 0 in Spark; after the scan rule it is filtered out
    assert df.where(F.col("c_acctbal") >= 0).count() == 1


def _customers(folder, **names):
    t = pa.table({names.get("c_custkey", "c_custkey"): pa.array([1, 2], pa.int64()), "c_name": ["a", "b"],
                  "c_nationkey": pa.array([0, 1], pa.int32()), names.get("c_acctbal", "c_acctbal"): [1.0, -2.0], "c_mktsegment": ["X", "Y"]})
    if names.get("drop"):
        t = t.drop_columns([names["drop"]])
    pq.write_table(t, str(folder / "customer.parquet"))


def test_a_renamed_column_is_an_error(spark, tmp_path):
    _customers(tmp_path, c_custkey="c_key")
    with pytest.raises(MissingColumns, match="lacks c_custkey; it has c_key"):
        read_table(spark, str(tmp_path), "customer", ["c_custkey", "c_name"])
    assert read_table(spark, str(tmp_path), "customer", ["c_name"]).count() == 2       # columns not asked for may be anything
    _customers(tmp_path)                                                              # the file is looked at again once it changes
    assert read_table(spark, str(tmp_path), "customer", ["c_custkey"]).count() == 2


def test_an_absent_column_reads_as_its_default(spark, tmp_path):
    _customers(tmp_path, drop="c_acctbal")
    df = read_table(spark, str(tmp_path), "customer", ["c_custkey", "c_acctbal"])
    assert df.schema["c_acctbal"].dataType.simpleString() == "double" and {r.c_acctbal for r in df.collect()} == {0.0}


def test_footers_are_read_without_a_job(spark, tmp_path):
    _customers(tmp_path)
    spark.sparkContext.setJobGroup("footers", "counted")
    read_table(spark, str(tmp_path), "customer", ["c_custkey"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("footers")) == 0
    spark.sparkContext.setJobGroup("other", "not counted")

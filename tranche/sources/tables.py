"""Table scans.

Reads parquet by name, keeps only the requested columns (so the scan's
``ReadSchema`` is pruned) and turns NaN into null in double columns at the
scan (D-10), so later comparisons and means behave like SQL nulls.

The columns asked for are compared with those in the file's footer (read in the
driver, once for each version of the file): a column that the file lacks takes its
declared default (``DEFAULTS``), and without one is an error, so a renamed column
never turns into nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tranche.functions.exprs import nan_to_null
from tranche.sources import files

# Declared schemas of the source tables: scans never infer (no footer-reading
# job per read).  A column of another type fails at the scan.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}


# Columns a source may lack, and what they read as (P14).  Every other column must be there.
DEFAULTS: dict[str, dict[str, object]] = {"customer": {"c_acctbal": 0.0}}


class MissingColumns(ValueError):
    """A source lacks columns that have no declared default."""


_COLUMNS: dict[tuple, list[str]] = {}


def columns_of(spark: SparkSession, sf_dir: str, name: str) -> list[str] | None:
    """Columns of a source by its first file's footer (None: it has no file), known until that file changes."""
    file = files.first_file(spark, table_path(sf_dir, name))
    if file is None:
        return None
    key = (spark.sparkContext.applicationId, *file)
    if key not in _COLUMNS:
        _COLUMNS[key] = files.parquet_columns(spark, file[0])
    return _COLUMNS[key]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Scan one table, optionally projected, with NaN -> null on floats."""
    if name not in RAW_SCHEMAS:
        df = spark.read.parquet(table_path(sf_dir, name))
        wanted = [F.col(c) for c in columns or df.columns]
    else:
        df = spark.read.schema(RAW_SCHEMAS[name]).parquet(table_path(sf_dir, name))
        there, default = columns_of(spark, sf_dir, name), DEFAULTS.get(name, {})
        absent = [c for c in columns or df.columns if there is not None and c not in there]
        if missing := [c for c in absent if c not in default]:
            raise MissingColumns(f"{table_path(sf_dir, name)} lacks {', '.join(missing)}; it has {', '.join(there)}")
        wanted = [F.lit(default[c]).cast(df.schema[c].dataType).alias(c) if c in absent else F.col(c) for c in columns or df.columns]
    df = df.select(*wanted)
    cleaned = [
        nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cleaned)

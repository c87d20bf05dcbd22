"""Small fixed dimensions built from the vocabularies in ``tranche.config``.

They are created from lists in code, so their size is known and bounded;
broadcasting them is always safe.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche import config as C


def risk_probability(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, Decimal(v)) for k, v in C.SUCCESS_PROBABILITY.items()],
                                 "classificacao_risco string, probabilidade decimal(3,2)")


def lookup_with_default(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join to a small fixed dim (broadcast) + default for misses."""
    vtype = dict(dim.dtypes)[value]
    lit = F.lit(Decimal(default) if vtype.startswith("decimal") else default).cast(vtype)
    return (df.join(F.broadcast(dim), key, "left")
            .withColumn(value, F.coalesce(F.col(value), lit)))

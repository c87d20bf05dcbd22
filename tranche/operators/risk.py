"""Company-risk views over ``company_scores`` (K8, P8, A6-A9, A12, A15,
A17, U2, K16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.functions import exprs as X

COMPONENTS = ["score_historico_cancelamento", "score_recencia", "score_valor_risco",
              "score_reincidencia", "score_comportamento"]
MEAN_DIGITS = 6  # means of doubles are rounded so the order of summation cannot show


def top_scores(scores: DataFrame, limit: int = 500) -> DataFrame:
    """K8: highest risk first (key as tie-breaker)."""
    return scores.orderBy(F.col("score_risco_final").desc_nulls_last(), F.col("cnpj_raiz").asc()).limit(limit)


def filter_companies(scores: DataFrame, classes: list[str] | None = None,
                     min_score: float = 0.0, min_active_value: float = 0.0) -> DataFrame:
    """Class IN (...) AND score >= a AND active value >= b.

    ``classes=None`` means no class filter (a null class would be dropped by
    IN, D-11); NaN scores were nulled at the scan, so they fail ``>=``."""
    out = scores.where((F.col("score_risco_final") >= min_score)
                       & (F.col("valor_ativos") >= min_active_value))
    if classes is not None:
        out = out.where(F.col("classificacao_risco").isin(list(classes)))
    return out


def risk_kpis(companies_scored: DataFrame) -> DataFrame:
    """A12, A8 (+ band), A7: count, mean score, active value, recidivists."""
    return companies_scored.agg(
        F.count(F.lit(1)).alias("qtd_empresas"),
        F.round(F.avg("score_risco_final"), MEAN_DIGITS).alias("score_medio"),
        F.coalesce(X.money_sum("valor_ativos"), F.lit(0).cast(X.MONEY)).alias("valor_ativos"),
        F.coalesce(F.sum("flag_reincidente"), F.lit(0)).cast("bigint").alias("empresas_reincidentes"),
    ).withColumn("faixa_score_medio", X.score_mean_band("score_medio"))


def component_means(companies_scored: DataFrame) -> DataFrame:
    """A9 + U2: mean of each score component, long form (component, mean)."""
    wide = companies_scored.agg(*[F.round(F.avg(c), MEAN_DIGITS).alias(c) for c in COMPONENTS])
    return wide.unpivot([], COMPONENTS, "componente", "media")


def histogram(df: DataFrame, value: str, bins: int = 50, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Equal-width histogram, value == hi falls in the last bin; nulls skipped."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(value).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("quantidade"))
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("inicio"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("fim"), "quantidade"))


def score_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """A17 on the final score scaled to 0-1."""
    return histogram(scores.select((F.col("score_risco_final") / 100.0).alias("p")), "p", bins)

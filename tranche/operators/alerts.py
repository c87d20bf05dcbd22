"""B12 ``alerts`` (T12) and alert views.

Candidates are active or pending agreements; each needs its company's score,
a ``lookup_join`` on ``cnpj_raiz`` with hot companies salted.  Rule precedence
leaves at most one alert per agreement.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X
from tranche.operators.skew import lookup_join


CANDIDATE_STATUS = (C.ST_ACTIVE, C.ST_PENDING)
SCORE_COLUMNS = ["cnpj_raiz", "score_risco_final", "classificacao_risco", "flag_reincidente"]


def alert_days(params: C.Params = C.DEFAULT):
    return F.datediff(F.lit(params.as_of), F.col("dt_pedido"))


def alert_type(params: C.Params = C.DEFAULT):
    """Rule precedence: recidivism, high value, cancellation risk, late first
    instalment; null when no rule fires (no alert)."""
    score = F.col("score_risco_final")
    high_value = F.lit(Decimal(params.alert_high_value)).cast(X.MONEY)
    return (F.when(F.col("flag_reincidente") == 1, F.lit(C.ALERT_TYPES[0]))
            .when(F.col("valor_parcelado") >= high_value, F.lit(C.ALERT_TYPES[1]))
            .when(score >= params.high_risk_score, F.lit(C.ALERT_TYPES[2]))
            .when((F.col("cd_status") == C.ST_PENDING) & (alert_days(params) > params.alert_late_days),
                  F.lit(C.ALERT_TYPES[3])))


def alert_priority():
    """1 URGENTE (score >= 80), 2 ALTA (>= 60), 3 MÉDIA (>= 40), else 4 BAIXA."""
    score = F.col("score_risco_final")
    return (F.when(score >= 80, F.lit(1)).when(score >= 60, F.lit(2))
            .when(score >= 40, F.lit(3)).otherwise(F.lit(4)))


def alerts(agreements: DataFrame, scores: DataFrame, params: C.Params = C.DEFAULT,
           hot: DataFrame | None = None) -> DataFrame:
    cand = (agreements.where(F.col("cd_status").isin(*CANDIDATE_STATUS))
            .select("num_parcelamento", "cnpj_raiz", "cnpj", "cd_status", "valor_parcelado", "dt_pedido"))
    # names come with the scores, which hold them already: no second join to the registry
    j = lookup_join(cand, scores.select(*SCORE_COLUMNS, "razao_social", "gerfe"), "cnpj_raiz", ["num_parcelamento"], params.skew, hot=hot)
    out = j.select("num_parcelamento", "cnpj_raiz", "cnpj", "razao_social", "gerfe",
                   alert_type(params).alias("tipo_alerta"), alert_priority().alias("prioridade"),
                   "valor_parcelado", alert_days(params).alias("dias_vida_parcelamento"), "classificacao_risco")
    return (out.where(F.col("tipo_alerta").isNotNull())
            .select("num_parcelamento", "cnpj_raiz", "cnpj", "razao_social", "gerfe", "tipo_alerta",
                    "prioridade", X.priority_label("prioridade").alias("desc_prioridade"),
                    "valor_parcelado", "dias_vida_parcelamento", "classificacao_risco"))


def top_alerts(alerts_df: DataFrame, limit: int = 100) -> DataFrame:
    """K7: priority asc, value desc (agreement id as tie-breaker), top ``limit``."""
    return alerts_df.orderBy(F.col("prioridade").asc_nulls_last(),
                             F.col("valor_parcelado").desc_nulls_last(),
                             F.col("num_parcelamento").asc()).limit(limit)


def filter_alerts(alerts_df: DataFrame, priorities: list[str] | None = None,
                  types: list[str] | None = None) -> DataFrame:
    """Priority label IN (...) AND type IN (...); ``None`` = no filter (D-11)."""
    out = alerts_df
    if priorities is not None:
        out = out.where(F.col("desc_prioridade").isin(list(priorities)))
    if types is not None:
        out = out.where(F.col("tipo_alerta").isin(list(types)))
    return out


def alert_kpis(alerts_df: DataFrame) -> DataFrame:
    """A12 + P10 + A7: total, urgent, high, value, in one pass."""
    return alerts_df.agg(
        F.count(F.lit(1)).alias("total_alertas"),
        F.count_if(F.col("prioridade") == 1).alias("alertas_urgentes"),
        F.count_if(F.col("prioridade") == 2).alias("alertas_alta"),
        F.coalesce(X.money_sum("valor_parcelado"), F.lit(0).cast(X.MONEY)).alias("valor_em_alerta"))


def frequency(df: DataFrame, key: str) -> DataFrame:
    """Value counts of ``key``, nulls dropped, count desc then key."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("quantidade"))
            .orderBy(F.col("quantidade").desc(), F.col(key).asc()))


def share(df: DataFrame, key: str) -> DataFrame:
    """A15 on counts: each group's share of all non-null rows (scalar total)."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("quantidade"))
    total = g.select(F.sum("quantidade")).scalar()
    return g.select(key, "quantidade",
                    (F.col("quantidade").cast("double") * 100.0 / total.cast("double")).alias("participacao_pct"))


def distinct_options(df: DataFrame, key: str) -> DataFrame:
    """Distinct filter options (sorted; the reference keeps first-seen order)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)

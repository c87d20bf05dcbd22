"""Drill-downs: J1 (region agreements), J2 (company profile), P12, W4,
K10, K11, K19.

Lookups by one key are filters by a literal, pushed into the parquet scans
(``Tables.for_companies``, ``Tables.top_of_region``).  J1 finds its top 500 first and
reads everything else for those agreements and their companies only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.functions import exprs as X

J1_COLUMNS = ["num_parcelamento", "cnpj", "razao_social", "categoria_parcelamento", "desc_status",
              "valor_parcelado", "num_parcelas", "dt_pedido"]


def j1_order() -> list:
    return [F.col("valor_parcelado").desc_nulls_last(), F.col("num_parcelamento").asc()]


def region_agreements(top: DataFrame, scores: DataFrame) -> DataFrame:
    """A region's largest agreements with company score, value desc.

    ``top`` is the bounded list of them, ``scores`` holds their companies at most."""
    sc = scores.select("cnpj_raiz", "score_risco_final", "classificacao_risco")
    return (top.join(F.broadcast(sc), "cnpj_raiz", "left")
            .select(*J1_COLUMNS, "score_risco_final", "classificacao_risco")
            .orderBy(*j1_order()))


def pick_companies(scores: DataFrame, n: int = 1) -> list[str]:
    """The first ``n`` companies in score order (key as tie-breaker), as a drill-down's parameter."""
    rows = (scores.orderBy(F.col("score_risco_final").desc_nulls_last(), F.col("cnpj_raiz").asc())
            .limit(n).select("cnpj_raiz").collect())
    return [r["cnpj_raiz"] for r in rows]


def company_profile(companies_df: DataFrame, scores: DataFrame) -> DataFrame:
    """Company row + its score components (tables of a company view)."""
    s = scores.select(
        "cnpj_raiz", "score_historico_cancelamento", "score_recencia", "score_valor_risco",
        "score_reincidencia", "score_comportamento", "score_risco_final", "classificacao_risco")
    return companies_df.join(s, "cnpj_raiz", "left").withColumn("faixa_sucesso", X.success_band("taxa_sucesso_pct"))


def company_agreements(agreements: DataFrame) -> DataFrame:
    """The company's agreements, newest first."""
    return agreements.orderBy(F.col("dt_pedido").desc_nulls_last(), F.col("num_parcelamento").desc())


def company_alerts(alerts_df: DataFrame) -> DataFrame:
    """The company's alerts by priority."""
    return alerts_df.orderBy("prioridade", "num_parcelamento")


def company_timeline(agreements_of_company: DataFrame) -> DataFrame:
    """Timeline bars, start = request, end = request + 30 days."""
    return agreements_of_company.select(
        "num_parcelamento", F.col("dt_pedido").alias("inicio"),
        X.plus_days("dt_pedido", 30).alias("fim"), "desc_status", "valor_parcelado", "num_parcelas")


def company_picker(scores: DataFrame, shown: int = 200) -> DataFrame:
    """K19 + F8: labels of the first ``shown`` companies by score."""
    top = scores.orderBy(F.col("score_risco_final").desc_nulls_last(), F.col("cnpj_raiz").asc()).limit(shown)
    return top.select("cnpj_raiz", "score_risco_final",
                      X.company_label("razao_social", "cnpj", "score_risco_final").alias("rotulo"))

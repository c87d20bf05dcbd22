"""P2 display tables: column subsets renamed by name (never by position) with
the F-functions applied as native expressions, one projection per report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.functions import exprs as X


def region_ranking_report(region: DataFrame) -> DataFrame:
    """Region ranking (success rate desc)."""
    return (region.orderBy(F.col("taxa_sucesso_pct").desc_nulls_last(), F.col("valor_total").desc(), "cd_gerfe")
            .select(F.col("gerfe").alias("Regional"), F.col("total_parcelamentos").alias("Total"),
                    F.col("empresas_distintas").alias("Empresas"), F.col("qtd_ativos").alias("Ativos"),
                    F.col("qtd_quitados").alias("Quitados"), F.col("qtd_cancelados").alias("Cancelados"),
                    F.col("taxa_sucesso_pct").alias("Taxa Sucesso %"),
                    X.format_brl_millions("valor_total").alias("Valor Total"),
                    F.col("empresas_alto_risco").alias("Alto Risco")))


def company_risk_report(scores: DataFrame) -> DataFrame:
    """Companies by score desc with formatted id and value."""
    return (scores.orderBy(F.col("score_risco_final").desc_nulls_last(), "cnpj_raiz")
            .select(X.format_tax_id("cnpj").alias("CNPJ"), F.col("razao_social").alias("Razão Social"),
                    F.col("classificacao_risco").alias("Risco"), F.col("score_risco_final").alias("Score"),
                    F.col("total_parcelamentos").alias("Total Parcelamentos"), F.col("qtd_ativos").alias("Ativos"),
                    F.col("qtd_cancelados").alias("Cancelados"),
                    X.format_brl("valor_ativos").alias("Valor Ativo"),
                    F.col("taxa_sucesso_pct").alias("Taxa Sucesso %"), F.col("gerfe").alias("GERFE")))


def time_report(series: DataFrame) -> DataFrame:
    return (series.orderBy("periodo_pedido")
            .select(F.col("periodo_pedido").alias("Período"), F.col("total_parcelamentos").alias("Total"),
                    F.col("qtd_ativos").alias("Ativos"), F.col("qtd_quitados").alias("Quitados"),
                    F.col("qtd_cancelados").alias("Cancelados"), F.col("taxa_sucesso_pct").alias("Taxa Sucesso %"),
                    X.format_brl_millions("valor_total").alias("Valor Total"),
                    X.format_brl("ticket_medio").alias("Ticket Médio")))


def alerts_report(alerts_df: DataFrame) -> DataFrame:
    return alerts_df.select(
        F.col("desc_prioridade").alias("Prioridade"), F.col("tipo_alerta").alias("Tipo"),
        F.col("razao_social").alias("Empresa"), X.format_tax_id("cnpj").alias("CNPJ"),
        X.format_brl("valor_parcelado").alias("Valor"), F.col("dias_vida_parcelamento").alias("Dias Ativo"),
        F.col("classificacao_risco").alias("Risco"), F.col("gerfe").alias("GERFE"))


def recovery_report(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("tipo_adesao").alias("Tipo Adesão"), F.col("origem_debito").alias("Origem"),
        F.col("cd_status").alias("Cód Status"), F.col("desc_status").alias("Status"),
        F.col("qtd").alias("Quantidade"), F.col("empresas").alias("Empresas"),
        X.format_brl_millions("valor_total").alias("Valor Total"),
        F.col("media_parcelas").alias("Média Parcelas"))


def company_history_report(agreements_of_company: DataFrame) -> DataFrame:
    return agreements_of_company.select(
        F.col("num_parcelamento").alias("Nº Parcelamento"), F.col("categoria_parcelamento").alias("Categoria"),
        F.col("desc_status").alias("Status"), X.format_brl("valor_parcelado").alias("Valor"),
        F.col("num_parcelas").alias("Parcelas"), F.col("dt_pedido").alias("Data Pedido"),
        F.col("faixa_parcelas").alias("Faixa"))


def ml_top_report(top: DataFrame) -> DataFrame:
    """M12 display: probability as percent text, formatted id and value."""
    return top.select(
        F.col("razao_social").alias("Razão Social"), X.format_tax_id("cnpj").alias("CNPJ"),
        X.format_pct(F.col("prob_cancelamento") * 100.0).alias("Prob. Cancelamento"),
        F.col("classificacao_risco").alias("Risco Atual"), X.format_brl("valor_ativos").alias("Valor Ativo"),
        F.col("qtd_ativos").alias("Ativos"), F.col("total_parcelamentos").alias("Total Parcelamentos"),
        F.col("gerfe").alias("GERFE"))

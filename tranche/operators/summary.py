"""B13 ``executive_summary`` (T13), U1 and S2.

Three global aggregates (partial per task, one final row each) are combined
with ``unionByName`` + ``max``: every column is non-null in exactly one part,
so no join of any kind is needed to put them side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X
from tranche.operators import alerts as AL
from tranche.operators import companies as CO
from tranche.operators import receipts as RC
from tranche.operators import recovery as RV
from tranche.operators.skew import lookup_join

SUMMARY_COLUMNS = [
    "total_parcelamentos", "total_empresas", "valor_total_parcelado", "taxa_sucesso_global_pct",
    "total_alertas", "alertas_urgentes", "qtd_ativos", "valor_ativos", "qtd_quitados",
    "valor_quitados", "qtd_cancelados", "valor_cancelados", "qtd_pendentes_1a_parcela",
    "qtd_icms", "qtd_dva", "qtd_declarado", "total_recuperamais",
    "valor_icms", "valor_dva", "valor_declarado", "valor_recuperamais",
    "empresas_risco_critico", "valor_empresas_alto_risco", "empresas_risco_alto",
    "empresas_reincidentes", "empresas_nunca_quitaram", "expectativa_3_meses",
    "expectativa_ajustada_3_meses", "expectativa_12_meses", "expectativa_ajustada_12_meses",
    "recuperamais_ativos", "recuperamais_quitados", "taxa_sucesso_recuperamais_pct",
]


def _msum(c) -> F.Column:
    """Money sum, 0 on empty input."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(X.MONEY)


def executive_summary(agreements: DataFrame, companies_df: DataFrame,
                      params: C.Params = C.DEFAULT, sides: list | None = None) -> DataFrame:
    """T13 in three passes: (1) one aggregate over the agreements, recovery
    counts included; (2) one over the scored companies; (3) one over the
    active/pending agreements joined to their company score, which feeds both
    the receipts sums (B4 rules) and the alert counts (B12 rules).  ``sides``: the
    agreements in parts, each with the way its company join goes (skew.py)."""
    st, v, cat = F.col("cd_status"), F.col("valor_parcelado"), F.col("categoria_parcelamento")
    rec = RV.recovery_predicate(params)
    p1 = agreements.agg(
        F.count(F.lit(1)).alias("total_parcelamentos"),
        _msum(v).alias("valor_total_parcelado"),
        F.count_if(st == C.ST_ACTIVE).alias("qtd_ativos"),
        _msum(F.when(st == C.ST_ACTIVE, v)).alias("valor_ativos"),
        F.count_if(st == C.ST_SETTLED).alias("qtd_quitados"),
        _msum(F.when(st == C.ST_SETTLED, v)).alias("valor_quitados"),
        F.count_if(st == C.ST_CANCELLED).alias("qtd_cancelados"),
        _msum(F.when(st == C.ST_CANCELLED, v)).alias("valor_cancelados"),
        F.count_if(st == C.ST_PENDING).alias("qtd_pendentes_1a_parcela"),
        F.count_if(cat == C.CAT_ICMS).alias("qtd_icms"),
        F.count_if(cat == C.CAT_DVA).alias("qtd_dva"),
        F.count_if(cat == C.CAT_DECLARED).alias("qtd_declarado"),
        _msum(F.when(cat == C.CAT_ICMS, v)).alias("valor_icms"),
        _msum(F.when(cat == C.CAT_DVA, v)).alias("valor_dva"),
        _msum(F.when(cat == C.CAT_DECLARED, v)).alias("valor_declarado"),
        F.count_if(rec).alias("total_recuperamais"),
        _msum(F.when(rec, v)).alias("valor_recuperamais"),
        F.count_if(rec & (st == C.ST_ACTIVE)).alias("recuperamais_ativos"),
        F.count_if(rec & (st == C.ST_SETTLED)).alias("recuperamais_quitados"),
        F.count_if(rec & (st == C.ST_CANCELLED)).alias("_rc"),
    ).select("*",
             X.success_rate(F.col("qtd_quitados"), F.col("qtd_cancelados")).alias("taxa_sucesso_global_pct"),
             X.success_rate(F.col("recuperamais_quitados"), F.col("_rc")).alias("taxa_sucesso_recuperamais_pct")
             ).drop("_rc")
    scored = CO.with_scores(companies_df)
    cls, score = F.col("classificacao_risco"), F.col("score_risco_final")
    p2 = scored.agg(
        F.count(F.lit(1)).alias("total_empresas"),
        F.count_if(F.col("flag_reincidente") == 1).alias("empresas_reincidentes"),
        F.count_if(F.col("flag_nunca_quitou") == 1).alias("empresas_nunca_quitaram"),
        F.count_if(cls == "CRÍTICO").alias("empresas_risco_critico"),
        _msum(F.when(score >= params.high_risk_score, F.col("valor_ativos"))).alias("valor_empresas_alto_risco"),
        F.count_if(cls == "ALTO").alias("empresas_risco_alto"))
    of_company = scored.select(*AL.SCORE_COLUMNS)

    def candidates(part: DataFrame, hot) -> DataFrame:
        cand = (part.where(F.col("cd_status").isin(*AL.CANDIDATE_STATUS))
                .select("num_parcelamento", "cnpj_raiz", "cd_status", "valor_parcelado", "num_parcelas", "dt_pedido"))
        return lookup_join(cand, of_company, "cnpj_raiz", ["num_parcelamento"], params.skew, hot=hot)

    j = reduce(DataFrame.unionByName, [candidates(*side) for side in sides or [(agreements, None)]])
    j = j.withColumn("risco_empresa", F.col("classificacao_risco"))
    in_receipts, kind = RC.receipt_filter(params), AL.alert_type(params)
    g3, g12 = RC.gross_expectation(3, params), RC.gross_expectation(12, params)
    p3 = j.agg(
        _msum(F.when(in_receipts, g3)).alias("expectativa_3_meses"),
        _msum(F.when(in_receipts, RC.adjusted_expectation(g3))).alias("expectativa_ajustada_3_meses"),
        _msum(F.when(in_receipts, g12)).alias("expectativa_12_meses"),
        _msum(F.when(in_receipts, RC.adjusted_expectation(g12))).alias("expectativa_ajustada_12_meses"),
        F.count_if(kind.isNotNull()).alias("total_alertas"),
        F.count_if(kind.isNotNull() & (AL.alert_priority() == 1)).alias("alertas_urgentes"))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p1, p2, p3])
    return u.agg(*[F.max(c).alias(c) for c in SUMMARY_COLUMNS])


def load_summary(summary: DataFrame) -> DataFrame:
    """The KPI row (``LIMIT 1``); one row by construction."""
    return summary.limit(1)


CATEGORY_ROWS = [("ICMS", "qtd_icms", "valor_icms"),
                 ("Dívida Ativa", "qtd_dva", "valor_dva"),
                 ("Declarado", "qtd_declarado", "valor_declarado"),
                 ("RECUPERA+", "total_recuperamais", "valor_recuperamais")]


def summary_categories(summary: DataFrame) -> DataFrame:
    """Wide KPI row -> 4 (category, quantity, value) rows; absent -> 0."""
    present = set(summary.columns)

    def pick(c, money):
        if c not in present:
            return F.lit(0).cast(X.MONEY if money else "bigint")
        return F.coalesce(F.col(c), F.lit(0)).cast(X.MONEY if money else "bigint")

    rows = F.array(*[F.struct(F.lit(label).alias("categoria"), pick(q, False).alias("quantidade"),
                              pick(val, True).alias("valor"))
                     for label, q, val in CATEGORY_ROWS])
    return summary.select(F.inline(rows))


def summary_cards(summary: DataFrame) -> DataFrame:
    """F4-F7 on the KPI row: the executive page's card texts."""
    return summary.select(
        X.format_int("total_parcelamentos").alias("card_total"),
        X.format_int("total_empresas").alias("card_empresas"),
        X.format_brl_billions("valor_total_parcelado").alias("card_valor"),
        X.format_pct("taxa_sucesso_global_pct").alias("card_taxa"),
        X.global_success_band("taxa_sucesso_global_pct").alias("faixa_taxa"),
        X.format_int("total_alertas").alias("card_alertas"),
        X.format_brl_billions("valor_ativos").alias("card_valor_ativos"),
        X.format_brl_millions("expectativa_3_meses").alias("card_expectativa_3m"),
        X.format_brl_millions("expectativa_ajustada_12_meses").alias("card_ajustada_12m"))

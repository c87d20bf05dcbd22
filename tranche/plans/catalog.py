"""Query catalogue: every registered query.

``QUERIES`` maps a query id to ``(spark_fn, oracle_sql)``; ``spark_fn`` takes a
``Tables`` and returns a DataFrame, ``oracle_sql`` is DuckDB SQL over the raw
tables (None where the operator is not SQL-expressible, e.g. the model).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X
from tranche.operators import alerts as AL
from tranche.operators import companies as CO
from tranche.operators import grouped as G
from tranche.operators import lookup as LK
from tranche.operators import receipts as RC
from tranche.operators import recovery as RV
from tranche.operators import reports as RP
from tranche.operators import risk as RK
from tranche.operators import series as SE
from tranche.operators import summary as SU
from tranche.plans import oracle as O
from tranche.plans.tables import Tables


@dataclass(frozen=True)
class Query:
    spark: Callable[[Tables], DataFrame]
    sql: str | None
    doc: str = ""


QUERIES: dict[str, Query] = {}


def q(qid: str, sql: str | None, doc: str = ""):
    def deco(fn):
        QUERIES[qid] = Query(fn, sql, doc)
        return fn
    return deco


W = O.with_tables

# ---------------------------------------------------------------------------
# B: derived-table builds (whole tables)
# ---------------------------------------------------------------------------
for _qid, _name, _doc in [
    ("b1_agreements", "agreements", "B1/J4/P1: consolidated agreements (T1)"),
    ("b2_companies", "companies", "B2: company profiles (T2)"),
    ("b3_company_scores", "scores", "B3: company risk scores (T3)"),
    ("b4_expected_receipts", "receipts", "B4: expected receipts, gross and risk-adjusted (T4)"),
    ("b5_monthly_series", "series", "B5: monthly series (T5)"),
    ("b6_region_metrics", "region", "B6: metrics by regional office (T6)"),
    ("b7_sector_metrics", "sector", "B7: metrics by sector group (T7)"),
    ("b8_activity_metrics", "activity", "B8: metrics by activity section (T8)"),
    ("b9_band_metrics", "band", "B9: metrics by instalment band (T9)"),
    ("b10_programme_metrics", "programme", "B10: metrics by special programme (T10)"),
    ("b11_recovery_agreements", "recovery", "B11: recovery-programme agreements (T11)"),
    ("b12_alerts", "alerts", "B12: prioritised alerts (T12)"),
    ("b13_executive_summary", "summary", "B13: executive summary row (T13)"),
]:
    QUERIES[_qid] = Query((lambda n: lambda t: getattr(t, n))(_name), W(_name) + f"SELECT * FROM {_name}", _doc)


EARLY_AS_OF = _dt.date(2000, 1, 1)
_EARLY_SQL = f"DATE '{EARLY_AS_OF.isoformat()}'"


def _early(t: Tables) -> Tables:
    """The same sources seen from an earlier as-of date, where many active
    agreements still have instalments due."""
    return Tables(t.spark, t.sf_dir, replace(t.params, as_of=EARLY_AS_OF))


@q("b4_expected_receipts_2000", (W("receipts") + "SELECT * FROM receipts").replace(O.AS_OF, _EARLY_SQL),
   "B4 at as-of 2000-01-01 (requests up to that date; instalments still due)")
def _b4e(t):
    return _early(t).receipts


@q("a2_receipts_summary_2000", (W("receipts") + f"""
SELECT risco_empresa, count(*) AS qtd_parcelamentos,
       CAST(sum(valor_esperado_3_meses) AS {O.MONEY}) AS total_3_meses,
       CAST(sum(valor_esperado_12_meses) AS {O.MONEY}) AS total_12_meses,
       CAST(sum(valor_ajustado_risco_3_meses) AS {O.MONEY}) AS ajustado_3_meses,
       CAST(sum(valor_ajustado_risco_12_meses) AS {O.MONEY}) AS ajustado_12_meses
FROM receipts GROUP BY risco_empresa""").replace(O.AS_OF, _EARLY_SQL), "A2 at as-of 2000-01-01")
def _a2e(t):
    return RC.receipts_summary(_early(t).receipts)


def _salted(t: Tables) -> Tables:
    """The same tables with a hot-key threshold that many companies of any test folder reach."""
    return Tables(t.spark, t.sf_dir, replace(t.params, skew=C.SkewParams(rows_per_bucket=8)))


@q("b4_expected_receipts_salted", W("receipts") + "SELECT * FROM receipts", "B4 with hot companies salted (low threshold)")
def _b4s(t):
    return _salted(t).receipts


@q("b12_alerts_salted", W("alerts") + "SELECT * FROM alerts", "B12 with hot companies salted (low threshold)")
def _b12s(t):
    return _salted(t).alerts


@q("b1_agreements_salted", W("agreements") + "SELECT * FROM agreements", "B1/J4 with hot companies salted (low threshold)")
def _b1s(t):
    return _salted(t).agreements


def _branched(t: Tables) -> Tables:
    """Companies with up to three branches each, in two sectors, told by the agreement's number."""
    n = F.col("num_parcelamento")
    return t.with_agreements(t.agreements
                             .withColumn("cnpj", F.concat("cnpj_raiz", F.lit("000"), (1 + n % 3).cast("string"), F.lit("00")))
                             .withColumn("ges", F.when(n % 2 == 0, F.col("ges")).otherwise(F.lit("FILIAL"))))


def _branched_sql(sql: str) -> str:
    return (sql.replace("cnpj_raiz || '000100' END AS cnpj", "cnpj_raiz || '000' || CAST(1 + num_parcelamento % 3 AS VARCHAR) || '00' END AS cnpj")
            .replace("c.c_mktsegment AS ges", "CASE WHEN o.o_orderkey % 2 = 0 THEN c.c_mktsegment ELSE 'FILIAL' END AS ges"))


for _qid, _name in [("b2_companies_branches", "companies"), ("b3_company_scores_branches", "scores"),
                    ("b4_expected_receipts_branches", "receipts"), ("b7_sector_metrics_branches", "sector"),
                    ("b9_band_metrics_branches", "band"), ("b12_alerts_branches", "alerts")]:
    QUERIES[_qid] = Query((lambda n: lambda t: getattr(_branched(t), n))(_name),
                          _branched_sql(W(_name) + f"SELECT * FROM {_name}"), f"{_qid.split('_')[0].upper()} where companies have several branches")


WINDOW = (_dt.date(1998, 1, 1), _dt.date(1998, 5, 31))


@q("b11_recovery_window", W("agreements") + f"""
SELECT num_parcelamento, cnpj_raiz, tipo_adesao, origem_debito, cd_status, desc_status,
       valor_parcelado, num_parcelas
FROM agreements WHERE categoria_parcelamento = 'RECUPERA+'
  AND CAST(dt_pedido AS DATE) >= DATE '{WINDOW[0].isoformat()}'
  AND CAST(dt_pedido AS DATE) <= DATE '{WINDOW[1].isoformat()}'""",
   "B11 with a January-May joining window (the window is a parameter)")
def _b11w(t):
    p = replace(t.params, recovery_start=WINDOW[0], recovery_end=WINDOW[1])
    return RV.recovery_agreements(t.agreements_core, p)


# ---------------------------------------------------------------------------
# Sources, sorts and limits
# ---------------------------------------------------------------------------
@q("s2_load_summary", W("summary") + "SELECT * FROM summary LIMIT 1", "S2/K1: the KPI row")
def _s2(t):
    return SU.load_summary(t.summary)


@q("k2_regions_by_value", W("region") + "SELECT * FROM region ORDER BY valor_total DESC, cd_gerfe, gerfe",
   "K2: regions by total value")
def _k2(t):
    return G.by_value_desc(t.region, G.GROUP_KEYS["region"])


@q("k3_sectors_by_value", W("sector") + "SELECT * FROM sector ORDER BY valor_total DESC, ges", "K3")
def _k3(t):
    return G.by_value_desc(t.sector, G.GROUP_KEYS["sector"])


@q("k5_top_activities", W("activity") + "SELECT * FROM activity ORDER BY valor_total DESC, descricao_secao LIMIT 15",
   "K5/K20: top activities by value (20, shown 15)")
def _k5(t):
    return G.by_value_desc(t.activity, G.GROUP_KEYS["activity"], limit=20).limit(15)


@q("k4_series_by_period", W("series") + "SELECT * FROM series ORDER BY periodo_pedido", "K4: series by period")
def _k4(t):
    return t.series.orderBy("periodo_pedido")


@q("k20_activities_ascending", W("activity") + """
SELECT * FROM (SELECT * FROM activity ORDER BY valor_total DESC, descricao_secao LIMIT 15)
ORDER BY valor_total ASC, descricao_secao""", "K20: the shown activities re-sorted ascending")
def _k20(t):
    return (G.by_value_desc(t.activity, G.GROUP_KEYS["activity"], limit=20).limit(15)
            .orderBy(F.col("valor_total").asc(), "descricao_secao"))


@q("k6_programmes_by_value", W("programme") + "SELECT * FROM programme ORDER BY valor_total DESC", "K6")
def _k6(t):
    return G.by_value_desc(t.programme, G.GROUP_KEYS["programme"])


@q("k7_top_alerts", W("alerts") + "SELECT * FROM alerts ORDER BY prioridade, valor_parcelado DESC, num_parcelamento LIMIT 100",
   "K7: top 100 alerts")
def _k7(t):
    return AL.top_alerts(t.alerts, 100)


@q("k8_top_scores", W("scores") + "SELECT * FROM scores ORDER BY score_risco_final DESC, cnpj_raiz LIMIT 500",
   "K8: top 500 companies by score")
def _k8(t):
    return RK.top_scores(t.scores, 500)


@q("k9_recovery_summary", W("recovery") + f"""
SELECT tipo_adesao, origem_debito, cd_status, desc_status, count(*) AS qtd,
       count(DISTINCT cnpj_raiz) AS empresas, CAST(sum(valor_parcelado) AS {O.MONEY}) AS valor_total,
       {O.avg_round1('sum(num_parcelas)', 'count(num_parcelas)')} AS media_parcelas
FROM recovery GROUP BY tipo_adesao, origem_debito, cd_status, desc_status
ORDER BY tipo_adesao, origem_debito, cd_status""", "A1/K9: recovery summary")
def _k9(t):
    return RV.recovery_summary(t.recovery).orderBy("tipo_adesao", "origem_debito", "cd_status")


@q("k13_recovery_detail", W("recovery") + "SELECT * FROM recovery ORDER BY valor_parcelado DESC NULLS LAST, num_parcelamento LIMIT 1000",
   "K13/S6: largest 1000 recovery agreements")
def _k13(t):
    return RV.recovery_detail(t.recovery, 1000)


@q("k14_regions_by_rate", W("region") + "SELECT * FROM region ORDER BY taxa_sucesso_pct ASC NULLS LAST, valor_total DESC, cd_gerfe",
   "K14: regions by success rate ascending")
def _k14(t):
    return G.by_rate(t.region, G.GROUP_KEYS["region"], ascending=True)


@q("k14_sectors_by_rate", W("sector") + "SELECT * FROM sector ORDER BY taxa_sucesso_pct ASC NULLS LAST, valor_total DESC, ges",
   "K14: sectors by success rate ascending")
def _k14s(t):
    return G.by_rate(t.sector, G.GROUP_KEYS["sector"], ascending=True)


@q("k15_region_ranking", W("region") + "SELECT * FROM region ORDER BY taxa_sucesso_pct DESC NULLS LAST, valor_total DESC, cd_gerfe",
   "K15/W3: region ranking by success rate")
def _k15(t):
    return G.by_rate(t.region, G.GROUP_KEYS["region"], ascending=False)


@q("k21_last_24_months", W("series") + "SELECT * FROM (SELECT * FROM series ORDER BY periodo_pedido DESC LIMIT 24) ORDER BY periodo_pedido",
   "W1/K21: last 24 months")
def _k21(t):
    return SE.last_periods(t.series, 24)


# ---------------------------------------------------------------------------
# Filters and options
# ---------------------------------------------------------------------------
@q("p6_ml_training_frame", W("ml_frame") + "SELECT * FROM ml_frame", "M1/P6/S7: training frame")
def _p6(t):
    from tranche.operators import model as M
    return M.training_frame(t.companies)


@q("p7_series_year", W("series") + "SELECT * FROM series WHERE ano_pedido = 2000", "P7: one year of the series")
def _p7(t):
    return t.series_of(2000)


def _p7c(t):
    return SE.monthly_series(t.agreements_core, [C.CAT_ICMS])


QUERIES["p7_series_category"] = Query(_p7c, W("agreements") + f"""
SELECT periodo_pedido, CAST(year(periodo_pedido) AS INTEGER) AS ano_pedido, total_parcelamentos, qtd_ativos,
       qtd_quitados, qtd_cancelados, qtd_icms, qtd_dva, qtd_declarado, qtd_recuperamais,
       CAST(coalesce(v, 0) AS {O.MONEY}) AS valor_total, CAST(coalesce(vq, 0) AS {O.MONEY}) AS valor_quitado,
       CAST(coalesce(vc, 0) AS {O.MONEY}) AS valor_cancelado, {O.money_avg('v', 'nv')} AS ticket_medio,
       {O.rate('qtd_quitados', 'qtd_quitados + qtd_cancelados')} AS taxa_sucesso_pct
FROM (SELECT CAST(date_trunc('month', dt_pedido) AS DATE) AS periodo_pedido, count(*) AS total_parcelamentos,
             count(*) FILTER (WHERE cd_status = 1) AS qtd_ativos, count(*) FILTER (WHERE cd_status = 5) AS qtd_quitados,
             count(*) FILTER (WHERE cd_status = 2) AS qtd_cancelados,
             count(*) FILTER (WHERE categoria_parcelamento = 'ICMS') AS qtd_icms,
             count(*) FILTER (WHERE categoria_parcelamento = 'DÍVIDA ATIVA') AS qtd_dva,
             count(*) FILTER (WHERE categoria_parcelamento = 'DECLARADO') AS qtd_declarado,
             count(*) FILTER (WHERE categoria_parcelamento = 'RECUPERA+') AS qtd_recuperamais,
             sum(valor_parcelado) AS v, count(valor_parcelado) AS nv,
             sum(CASE WHEN cd_status = 5 THEN valor_parcelado END) AS vq,
             sum(CASE WHEN cd_status = 2 THEN valor_parcelado END) AS vc
      FROM agreements WHERE dt_pedido IS NOT NULL AND categoria_parcelamento IN ('ICMS') GROUP BY 1) t""",
    "D-4/P7: series for one category")


@q("p8_filtered_companies", W("scores") + """
SELECT * FROM scores WHERE score_risco_final >= 50 AND valor_ativos >= 100000
  AND classificacao_risco IN ('CRÍTICO', 'ALTO')""", "P8: risk filter")
def _p8(t):
    return RK.filter_companies(t.scores, ["CRÍTICO", "ALTO"], 50.0, 100000.0)


@q("p9_filtered_alerts", W("alerts") + """
SELECT * FROM alerts WHERE desc_prioridade IN ('URGENTE', 'ALTA') AND tipo_alerta IN ('REINCIDÊNCIA', 'VALOR ELEVADO')""",
   "P9: alert filter")
def _p9(t):
    return AL.filter_alerts(t.alerts, ["URGENTE", "ALTA"], ["REINCIDÊNCIA", "VALOR ELEVADO"])


_RISKY = "score_risco_final >= 50 AND valor_ativos >= 100000 AND classificacao_risco IN ('CRÍTICO', 'ALTO')"
_PICKED_ALERTS = "desc_prioridade IN ('URGENTE', 'ALTA') AND tipo_alerta IN ('REINCIDÊNCIA', 'VALOR ELEVADO')"


def _chained_sql(qid: str, table: str, condition: str) -> str:
    """The oracle of ``qid`` over the filtered rows of ``table``."""
    head, tail = QUERIES[qid].sql[:len(W(table))], QUERIES[qid].sql[len(W(table)):]
    return head + tail.replace(f"FROM {table}", f"FROM (SELECT * FROM {table} WHERE {condition})")


@q("p17_alert_priority_options", W("alerts") + "SELECT DISTINCT desc_prioridade FROM alerts WHERE desc_prioridade IS NOT NULL ORDER BY 1",
   "P17: alert priorities")
def _p17p(t):
    return AL.distinct_options(t.alerts, "desc_prioridade")


@q("p17_year_options", W("series") + "SELECT DISTINCT ano_pedido FROM series ORDER BY ano_pedido", "P17: years")
def _p17y(t):
    return SE.year_options(t.series)


@q("p17_alert_type_options", W("alerts") + "SELECT DISTINCT tipo_alerta FROM alerts WHERE tipo_alerta IS NOT NULL ORDER BY 1",
   "P17: alert types")
def _p17t(t):
    return AL.distinct_options(t.alerts, "tipo_alerta")


@q("p17_risk_class_options", W("scores") + "SELECT DISTINCT classificacao_risco FROM scores WHERE classificacao_risco IS NOT NULL ORDER BY 1",
   "P17: risk classes")
def _p17r(t):
    return AL.distinct_options(t.scores, "classificacao_risco")


@q("p17_region_options", W("region") + "SELECT cd_gerfe, gerfe FROM region ORDER BY valor_total DESC, cd_gerfe",
   "P17: region selector entries, listed as ranked by value (not deduplicated)")
def _p17g(t):
    return G.region_options(G.by_value_desc(t.region, ["cd_gerfe"]))


@q("p12_region_by_name", W("region") + "SELECT * FROM region WHERE gerfe = 'NATION_7' ORDER BY cd_gerfe LIMIT 1",
   "P12: first region row matching a display name")
def _p12(t):
    return G.region_by_name(t.region, "NATION_7")


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------
@q("a1_recovery_grouping_sets", W("recovery") + f"""
SELECT tipo_adesao, origem_debito, cd_status, desc_status,
       CAST(GROUPING(tipo_adesao, origem_debito, cd_status, desc_status) AS INTEGER) AS nivel,
       CAST(count(*) AS BIGINT) AS qtd, count(DISTINCT cnpj_raiz) AS empresas,
       CAST(sum(valor_parcelado) AS {O.MONEY}) AS valor_total,
       {O.avg_round1('sum(num_parcelas)', 'count(num_parcelas)')} AS media_parcelas
FROM recovery
GROUP BY GROUPING SETS ((tipo_adesao, origem_debito, cd_status, desc_status), (tipo_adesao),
                        (desc_status), (origem_debito, desc_status), ())""",
   "A1+A3+A4+A5+total in one GROUPING SETS pass")
def _a1gs(t):
    return RV.recovery_cube(t.recovery)


@q("a2_receipts_summary", W("receipts") + f"""
SELECT risco_empresa, count(*) AS qtd_parcelamentos,
       CAST(sum(valor_esperado_3_meses) AS {O.MONEY}) AS total_3_meses,
       CAST(sum(valor_esperado_12_meses) AS {O.MONEY}) AS total_12_meses,
       CAST(sum(valor_ajustado_risco_3_meses) AS {O.MONEY}) AS ajustado_3_meses,
       CAST(sum(valor_ajustado_risco_12_meses) AS {O.MONEY}) AS ajustado_12_meses
FROM receipts GROUP BY risco_empresa""", "A2: receipts by risk class")
def _a2(t):
    return RC.receipts_summary(t.receipts)


@q("a3_recovery_by_join_type", W("recovery") + f"""
SELECT tipo_adesao, count(*) AS qtd, count(DISTINCT cnpj_raiz) AS empresas,
       CAST(sum(valor_parcelado) AS {O.MONEY}) AS valor_total
FROM recovery WHERE tipo_adesao IS NOT NULL GROUP BY tipo_adesao""", "A3: by join type, exact companies")
def _a3(t):
    return RV.by_join_type(t.recovery)


@q("a4_recovery_by_status", W("recovery") + """
SELECT desc_status, count(*) AS qtd FROM recovery WHERE desc_status IS NOT NULL GROUP BY desc_status""",
   "A4: by status")
def _a4(t):
    return RV.by_status(t.recovery)


@q("a5_recovery_by_origin_status", W("recovery") + f"""
SELECT origem_debito, desc_status, count(*) AS qtd, CAST(sum(valor_parcelado) AS {O.MONEY}) AS valor_total
FROM recovery WHERE origem_debito IS NOT NULL AND desc_status IS NOT NULL
GROUP BY origem_debito, desc_status""", "A5: by origin and status")
def _a5(t):
    return RV.by_origin_status(t.recovery)


@q("a6_risk_class_frequency", W("scores") + """
SELECT classificacao_risco, count(*) AS quantidade FROM scores WHERE classificacao_risco IS NOT NULL
GROUP BY 1 ORDER BY quantidade DESC, classificacao_risco""", "A6: companies by risk class")
def _a6r(t):
    return AL.frequency(t.scores, "classificacao_risco")


@q("a6_alert_priority_frequency", W("alerts") + """
SELECT desc_prioridade, count(*) AS quantidade FROM alerts WHERE desc_prioridade IS NOT NULL
GROUP BY 1 ORDER BY quantidade DESC, desc_prioridade""", "A6: alerts by priority")
def _a6p(t):
    return AL.frequency(t.alerts, "desc_prioridade")


@q("a6_alert_type_frequency", W("alerts") + """
SELECT tipo_alerta, count(*) AS quantidade FROM alerts WHERE tipo_alerta IS NOT NULL
GROUP BY 1 ORDER BY quantidade DESC, tipo_alerta""", "A6: alerts by type")
def _a6t(t):
    return AL.frequency(t.alerts, "tipo_alerta")


@q("a7_alert_kpis", W("alerts") + f"""
SELECT count(*) AS total_alertas, count(*) FILTER (WHERE prioridade = 1) AS alertas_urgentes,
       count(*) FILTER (WHERE prioridade = 2) AS alertas_alta,
       CAST(coalesce(sum(valor_parcelado), 0) AS {O.MONEY}) AS valor_em_alerta FROM alerts""",
   "A7/A12/P10: alert KPIs over all alerts (D-2)")
def _a7a(t):
    return AL.alert_kpis(t.alerts)


@q("a7_a13_recovery_kpis", W("recovery") + f"""
SELECT count(*) AS total_adesoes, count(DISTINCT cnpj_raiz) AS empresas,
       CAST(coalesce(sum(valor_parcelado), 0) AS {O.MONEY}) AS valor_total,
       coalesce({O.rate("count(*) FILTER (WHERE cd_status = 5)", "count(*) FILTER (WHERE cd_status = 5) + count(*) FILTER (WHERE cd_status = 2)")}, 0.0) AS taxa_sucesso_pct
FROM recovery""", "A7/A13: recovery KPIs, success rate 0 when nothing ended")
def _a7r(t):
    return RV.recovery_kpis(t.recovery)


@q("a8_risk_kpis", W("scores") + f"""
SELECT qtd_empresas, score_medio, valor_ativos, empresas_reincidentes,
       CASE WHEN score_medio < 40 THEN 'BAIXO' WHEN score_medio <= 60 THEN 'MODERADO'
            WHEN score_medio IS NOT NULL THEN 'ALTO' END AS faixa_score_medio
FROM (SELECT count(*) AS qtd_empresas, round(avg(score_risco_final), {RK.MEAN_DIGITS}) AS score_medio,
             CAST(coalesce(sum(valor_ativos), 0) AS {O.MONEY}) AS valor_ativos,
             CAST(coalesce(sum(flag_reincidente), 0) AS BIGINT) AS empresas_reincidentes FROM scores) t""",
   "A8/A12/A7: risk-page KPIs over all companies")
def _a8(t):
    return RK.risk_kpis(t.scores)


@q("a9_u2_component_means", W("scores") + f"""
SELECT componente, media FROM (SELECT
  round(avg(score_historico_cancelamento), {RK.MEAN_DIGITS}) AS score_historico_cancelamento,
  round(avg(score_recencia), {RK.MEAN_DIGITS}) AS score_recencia,
  round(avg(score_valor_risco), {RK.MEAN_DIGITS}) AS score_valor_risco,
  round(avg(score_reincidencia), {RK.MEAN_DIGITS}) AS score_reincidencia,
  round(avg(score_comportamento), {RK.MEAN_DIGITS}) AS score_comportamento FROM scores) t
UNPIVOT (media FOR componente IN (score_historico_cancelamento, score_recencia, score_valor_risco,
                                  score_reincidencia, score_comportamento))""",
   "A9/U2: mean score components, long form")
def _a9(t):
    return RK.component_means(t.scores)


@q("a10_a11_region_kpis", W("region") + """
SELECT (SELECT count(*) FROM region) AS qtd_regionais,
       (SELECT gerfe FROM region WHERE taxa_sucesso_pct IS NOT NULL
        ORDER BY taxa_sucesso_pct DESC, valor_total DESC, cd_gerfe LIMIT 1) AS melhor_gerfe,
       (SELECT max(taxa_sucesso_pct) FROM region) AS melhor_taxa_pct,
       (SELECT gerfe FROM region WHERE taxa_sucesso_pct IS NOT NULL
        ORDER BY taxa_sucesso_pct ASC, valor_total DESC, cd_gerfe LIMIT 1) AS pior_gerfe,
       (SELECT min(taxa_sucesso_pct) FROM region) AS pior_taxa_pct,
       (SELECT CAST(coalesce(sum(empresas_alto_risco), 0) AS BIGINT) FROM region) AS empresas_alto_risco""",
   "A7/A10/A11/A12: regional KPIs, arg-max/arg-min region")
def _a10(t):
    return G.region_kpis(t.region)


@q("a14_feature_medians", W("ml_frame") + "SELECT " + ", ".join(
    f"median(CAST({c} AS DOUBLE)) AS {c}" for c in C.ML_FEATURES) + " FROM ml_frame",
   "A14: exact medians of the model features")
def _a14(t):
    from tranche.operators import model as M
    return M.feature_medians(M.training_frame(t.companies))


@q("a15_sector_value_share", W("sector") + f"""
SELECT ges, valor_total, CASE WHEN tot > 0 THEN CAST(valor_total AS DOUBLE) * 100.0 / CAST(tot AS DOUBLE) END AS participacao_pct
FROM (SELECT ges, CAST(sum(valor_total) AS {O.MONEY}) AS valor_total FROM sector WHERE ges IS NOT NULL GROUP BY ges) g,
     (SELECT sum(valor_total) AS tot FROM (SELECT CAST(sum(valor_total) AS {O.MONEY}) AS valor_total
      FROM sector WHERE ges IS NOT NULL GROUP BY ges)) s""", "A15: sector value share (pie)")
def _a15s(t):
    return G.value_share(t.sector, "ges")


def _share_sql(table: str, key: str) -> str:
    return W(table) + f"""
SELECT {key}, quantidade, CAST(quantidade AS DOUBLE) * 100.0 / CAST(sum(quantidade) OVER () AS DOUBLE) AS participacao_pct
FROM (SELECT {key}, count(*) AS quantidade FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}) g"""


@q("a15_risk_class_share", _share_sql("scores", "classificacao_risco"), "A15: risk-class share")
def _a15r(t):
    return AL.share(t.scores, "classificacao_risco")


@q("a15_alert_priority_share", _share_sql("alerts", "desc_prioridade"), "A15: alert priority share")
def _a15p(t):
    return AL.share(t.alerts, "desc_prioridade")


@q("a15_recovery_join_type_share", _share_sql("recovery", "tipo_adesao"), "A15: recovery join-type share")
def _a15j(t):
    return AL.share(t.recovery, "tipo_adesao")


@q("a15_recovery_status_share", _share_sql("recovery", "desc_status"), "A15: recovery status share")
def _a15st(t):
    return AL.share(t.recovery, "desc_status")


@q("a16_region_treemap", W("region") + "SELECT gerfe, valor_total, taxa_sucesso_pct, qtd_ativos, empresas_distintas FROM region",
   "A16: treemap data")
def _a16(t):
    return G.region_treemap(t.region)


@q("a17_score_histogram", W("scores") + """
SELECT bin, CAST(0.0 AS DOUBLE) + bin * CAST(0.02 AS DOUBLE) AS inicio,
       CAST(0.0 AS DOUBLE) + (bin + 1) * CAST(0.02 AS DOUBLE) AS fim, quantidade FROM (
  SELECT CAST(least(floor((p - 0.0) / 1.0 * 50), 49) AS INTEGER) AS bin, count(*) AS quantidade
  FROM (SELECT score_risco_final / 100.0 AS p FROM scores) s WHERE p IS NOT NULL GROUP BY 1) t""",
   "A17: 50-bin histogram of the score (0-1)")
def _a17(t):
    return RK.score_histogram(t.scores, 50)


@q("a18_origin_status_pivot", W("recovery") + """
SELECT origem_debito,
       count(*) FILTER (WHERE desc_status = 'ATIVO') AS qtd_ativo,
       count(*) FILTER (WHERE desc_status = 'QUITADO') AS qtd_quitado,
       count(*) FILTER (WHERE desc_status = 'CANCELADO') AS qtd_cancelado,
       count(*) FILTER (WHERE desc_status = 'PENDENTE 1ª PARCELA') AS qtd_pendente
FROM recovery WHERE origem_debito IS NOT NULL GROUP BY origem_debito""", "A18: origin x status grouped bars")
def _a18(t):
    return RV.origin_status_pivot(t.recovery)


# ---------------------------------------------------------------------------
# Reshaping
# ---------------------------------------------------------------------------
@q("u1_summary_categories", W("summary") + f"""
SELECT 'ICMS' AS categoria, CAST(coalesce(qtd_icms, 0) AS BIGINT) AS quantidade, CAST(coalesce(valor_icms, 0) AS {O.MONEY}) AS valor FROM summary
UNION ALL SELECT 'Dívida Ativa', CAST(coalesce(qtd_dva, 0) AS BIGINT), CAST(coalesce(valor_dva, 0) AS {O.MONEY}) FROM summary
UNION ALL SELECT 'Declarado', CAST(coalesce(qtd_declarado, 0) AS BIGINT), CAST(coalesce(valor_declarado, 0) AS {O.MONEY}) FROM summary
UNION ALL SELECT 'RECUPERA+', CAST(coalesce(total_recuperamais, 0) AS BIGINT), CAST(coalesce(valor_recuperamais, 0) AS {O.MONEY}) FROM summary""",
   "U1/P14/P15: KPI row -> 4 category rows")
def _u1(t):
    return SU.summary_categories(t.summary)


@q("u3_receipts_long", W("receipts") + f"""
SELECT risco_empresa, tipo, valor FROM (
  SELECT risco_empresa, CAST(sum(valor_esperado_3_meses) AS {O.MONEY}) AS total_3_meses,
         CAST(sum(valor_ajustado_risco_3_meses) AS {O.MONEY}) AS ajustado_3_meses,
         CAST(sum(valor_esperado_12_meses) AS {O.MONEY}) AS total_12_meses,
         CAST(sum(valor_ajustado_risco_12_meses) AS {O.MONEY}) AS ajustado_12_meses
  FROM receipts GROUP BY risco_empresa) t
UNPIVOT INCLUDE NULLS (valor FOR tipo IN (total_3_meses, ajustado_3_meses, total_12_meses, ajustado_12_meses))""",
   "U3: gross vs adjusted, long form")
def _u3(t):
    return RC.receipts_long(RC.receipts_summary(t.receipts))


@q("u4_series_status_long", W("series") + """
SELECT periodo_pedido, strftime(periodo_pedido, '%Y-%m') AS periodo, status, quantidade FROM (
  SELECT periodo_pedido, qtd_ativos AS "ATIVO", qtd_quitados AS "QUITADO", qtd_cancelados AS "CANCELADO" FROM series) t
UNPIVOT (quantidade FOR status IN ("ATIVO", "QUITADO", "CANCELADO"))""", "U4/F11: monthly counts by status, long")
def _u4(t):
    return SE.series_status_long(t.series)


@q("w2_series_category_long", W("series") + """
SELECT periodo_pedido, categoria, quantidade FROM (
  SELECT periodo_pedido, qtd_icms AS "ICMS", qtd_dva AS "DÍVIDA ATIVA", qtd_declarado AS "DECLARADO",
         qtd_recuperamais AS "RECUPERA+" FROM series) t
UNPIVOT (quantidade FOR categoria IN ("ICMS", "DÍVIDA ATIVA", "DECLARADO", "RECUPERA+"))""",
   "W2/U4: monthly counts by category, long")
def _w2(t):
    return SE.series_category_long(t.series)


@q("p16_series_values", W("series") + """
SELECT periodo_pedido, CAST(valor_quitado AS DOUBLE) / 1e6 AS valor_quitado_mi,
       CAST(valor_cancelado AS DOUBLE) / 1e6 AS valor_cancelado_mi,
       CAST(ticket_medio AS DOUBLE) / 1e3 AS ticket_medio_mil, taxa_sucesso_pct FROM series""",
   "P16: unit-scaled value lines")
def _p16(t):
    return SE.series_values(t.series)


@q("u4_series_values_long", W("series") + """
SELECT periodo_pedido, serie, valor_mi FROM (
  SELECT periodo_pedido, CAST(valor_quitado AS DOUBLE) / 1e6 AS "QUITADO", CAST(valor_cancelado AS DOUBLE) / 1e6 AS "CANCELADO" FROM series) t
UNPIVOT INCLUDE NULLS (valor_mi FOR serie IN ("QUITADO", "CANCELADO"))""", "U4/P16: value lines, long")
def _u4v(t):
    return SE.series_values_long(t.series)


@q("p19_receipts_gap", W("summary") + f"""
SELECT CAST(CASE WHEN g3 > 0 THEN g3 END AS {O.MONEY}) AS gap_3_meses,
       CASE WHEN g3 > 0 THEN '-' || {O.brl_mm('g3')} || ' em risco' END AS gap_3_meses_texto,
       CAST(CASE WHEN g12 > 0 THEN g12 END AS {O.MONEY}) AS gap_12_meses,
       CASE WHEN g12 > 0 THEN '-' || {O.brl_mm('g12')} || ' em risco' END AS gap_12_meses_texto
FROM (SELECT coalesce(expectativa_3_meses, 0) - coalesce(expectativa_ajustada_3_meses, 0) AS g3,
             coalesce(expectativa_12_meses, 0) - coalesce(expectativa_ajustada_12_meses, 0) AS g12 FROM summary) t""",
   "P19/F9: receipts gap and its text")
def _p19(t):
    return RC.receipts_gap(t.summary)


# ---------------------------------------------------------------------------
# Drill-downs
# ---------------------------------------------------------------------------
_TOP_REGION = "(SELECT cd_gerfe FROM region ORDER BY valor_total DESC, cd_gerfe LIMIT 1)"
_TOP_COMPANY = "(SELECT cnpj_raiz FROM scores ORDER BY score_risco_final DESC, cnpj_raiz LIMIT 1)"


def _top_region(t: Tables) -> int:
    """The region a user would open first (largest total value): J1's
    parameter, resolved once as a value so the drill-down plan stays small."""
    return G.by_value_desc(t.region, ["cd_gerfe"]).limit(1).select("cd_gerfe").first()[0]


@q("j1_region_agreements", W("agreements", "scores", "region") + f"""
SELECT a.num_parcelamento, a.cnpj, a.razao_social, a.categoria_parcelamento, a.desc_status,
       a.valor_parcelado, a.num_parcelas, a.dt_pedido, s.score_risco_final, s.classificacao_risco
FROM agreements a LEFT JOIN scores s ON a.cnpj_raiz = s.cnpj_raiz
WHERE a.cd_gerfe = {_TOP_REGION}
ORDER BY a.valor_parcelado DESC NULLS LAST, a.num_parcelamento LIMIT 500""",
   "J1/P3/P5/K12: top-value region's agreements with scores")
def _j1(t):
    return t.region_agreements(_top_region(t), 500)


def _picked(t: Tables) -> Tables:
    """The drill-down view of the highest-risk company (J2's parameter)."""
    return t.for_companies(LK.pick_companies(t.scores, 1))


@q("j2_company_profile", W("companies", "scores") + f"""
SELECT c.*, s.score_historico_cancelamento, s.score_recencia, s.score_valor_risco, s.score_reincidencia,
       s.score_comportamento, s.score_risco_final, s.classificacao_risco,
       CASE WHEN c.taxa_sucesso_pct >= 70 THEN 'BOM' WHEN c.taxa_sucesso_pct >= 50 THEN 'MODERADO'
            WHEN c.taxa_sucesso_pct IS NOT NULL THEN 'ATENÇÃO' END AS faixa_sucesso
FROM companies c LEFT JOIN scores s ON s.cnpj_raiz = c.cnpj_raiz
WHERE c.cnpj_raiz = {_TOP_COMPANY}""", "J2/P4: profile of the highest-risk company")
def _j2(t):
    v = _picked(t)
    return LK.company_profile(v.companies, v.scores)


@q("k10_company_agreements", W("agreements", "scores") + f"""
SELECT * FROM agreements WHERE cnpj_raiz = {_TOP_COMPANY} ORDER BY dt_pedido DESC NULLS LAST, num_parcelamento DESC""",
   "J2/K10: the company's agreements, newest first")
def _k10(t):
    return LK.company_agreements(_picked(t).agreements)


@q("k11_company_alerts", W("alerts", "scores") + f"""
SELECT * FROM alerts WHERE cnpj_raiz = {_TOP_COMPANY} ORDER BY prioridade, num_parcelamento""",
   "J2/K11: the company's alerts by priority")
def _k11(t):
    return LK.company_alerts(_picked(t).alerts)


@q("j2_company_receipts", W("receipts", "scores") + f"""
SELECT * FROM receipts WHERE cnpj_raiz = {_TOP_COMPANY}""", "J2: the company's expected receipts")
def _j2r(t):
    return _picked(t).receipts


@q("w4_company_timeline", W("agreements", "scores") + f"""
SELECT num_parcelamento, dt_pedido AS inicio, dt_pedido + INTERVAL 30 DAY AS fim, desc_status,
       valor_parcelado, num_parcelas
FROM agreements WHERE cnpj_raiz = {_TOP_COMPANY}""", "W4/F10: the company's timeline bars")
def _w4(t):
    return LK.company_timeline(LK.company_agreements(_picked(t).agreements))


@q("k19_company_picker", W("scores") + f"""
SELECT cnpj_raiz, score_risco_final,
       razao_social || ' - ' || {O.tax_id_pretty('cnpj')} || ' (Score: ' || format('{{:.0f}}', score_risco_final) || ')' AS rotulo
FROM scores ORDER BY score_risco_final DESC, cnpj_raiz LIMIT 200""", "K19/F8: company picker labels")
def _k19(t):
    return LK.company_picker(t.scores, 200)


# ---------------------------------------------------------------------------
# Scalar functions and display reports (F, P2)
# ---------------------------------------------------------------------------
@q("f1_f2_tax_ids", W("companies") + f"""
SELECT cnpj_raiz, {O.tax_id_clean('cnpj_raiz')} AS cnpj_normalizado, {O.tax_id_pretty('cnpj')} AS cnpj_formatado
FROM companies""", "F1/F2 on every company id")
def _f12(t):
    return t.companies.select("cnpj_raiz", X.normalize_tax_id("cnpj_raiz").alias("cnpj_normalizado"),
                              X.format_tax_id("cnpj").alias("cnpj_formatado"))


@q("f12_f14_company_gaps", W("companies") + f"""
SELECT cnpj_raiz, media_dias_quitacao IS NULL AS sem_quitacao, media_dias_ate_cancelamento IS NULL AS sem_cancelamento,
       taxa_sucesso_pct IS NULL AS sem_taxa,
       round(media_parcelas, 1) AS media_parcelas_1
FROM companies""", "F12/F14: which measures a company lacks, and its mean instalments to one decimal")
def _f1214(t):
    return t.companies.select("cnpj_raiz", X.is_missing("media_dias_quitacao").alias("sem_quitacao"),
                              X.is_missing("media_dias_ate_cancelamento").alias("sem_cancelamento"),
                              X.is_missing("taxa_sucesso_pct").alias("sem_taxa"),
                              X.round1("media_parcelas").alias("media_parcelas_1"))


@q("f3_f7_summary_cards", W("summary") + f"""
SELECT {O.fmt_int('total_parcelamentos')} AS card_total, {O.fmt_int('total_empresas')} AS card_empresas,
       {O.brl_bi('valor_total_parcelado')} AS card_valor, {O.pct('taxa_sucesso_global_pct')} AS card_taxa,
       CASE WHEN taxa_sucesso_global_pct > 70 THEN 'EXCELENTE' WHEN taxa_sucesso_global_pct >= 50 THEN 'ADEQUADO'
            WHEN taxa_sucesso_global_pct IS NOT NULL THEN 'ATENÇÃO' END AS faixa_taxa,
       {O.fmt_int('total_alertas')} AS card_alertas, {O.brl_bi('valor_ativos')} AS card_valor_ativos,
       {O.brl_mm('expectativa_3_meses')} AS card_expectativa_3m,
       {O.brl_mm('expectativa_ajustada_12_meses')} AS card_ajustada_12m FROM summary""",
   "F4-F7/F13: executive card texts")
def _f37(t):
    return SU.summary_cards(t.summary)


@q("p2_region_ranking_report", W("region") + f"""
SELECT gerfe AS "Regional", total_parcelamentos AS "Total", empresas_distintas AS "Empresas",
       qtd_ativos AS "Ativos", qtd_quitados AS "Quitados", qtd_cancelados AS "Cancelados",
       taxa_sucesso_pct AS "Taxa Sucesso %", {O.brl_mm('valor_total')} AS "Valor Total",
       empresas_alto_risco AS "Alto Risco"
FROM region ORDER BY taxa_sucesso_pct DESC NULLS LAST, valor_total DESC, cd_gerfe""",
   "P2/K15/F4: region ranking table")
def _p2r(t):
    return RP.region_ranking_report(t.region)


@q("p2_company_risk_report", W("scores") + f"""
SELECT {O.tax_id_pretty('cnpj')} AS "CNPJ", razao_social AS "Razão Social", classificacao_risco AS "Risco",
       score_risco_final AS "Score", total_parcelamentos AS "Total Parcelamentos", qtd_ativos AS "Ativos",
       qtd_cancelados AS "Cancelados", {O.brl('valor_ativos')} AS "Valor Ativo",
       taxa_sucesso_pct AS "Taxa Sucesso %", gerfe AS "GERFE"
FROM scores ORDER BY score_risco_final DESC, cnpj_raiz""", "P2/K16/F2/F3: company risk table")
def _p2c(t):
    return RP.company_risk_report(t.scores)


@q("p2_time_report", W("series") + f"""
SELECT periodo_pedido AS "Período", total_parcelamentos AS "Total", qtd_ativos AS "Ativos",
       qtd_quitados AS "Quitados", qtd_cancelados AS "Cancelados", taxa_sucesso_pct AS "Taxa Sucesso %",
       {O.brl_mm('valor_total')} AS "Valor Total", {O.brl('ticket_medio')} AS "Ticket Médio"
FROM series ORDER BY periodo_pedido""", "P2/F3/F4: monthly detail table")
def _p2t(t):
    return RP.time_report(t.series)


@q("p2_alerts_report", W("alerts") + f"""
SELECT desc_prioridade AS "Prioridade", tipo_alerta AS "Tipo", razao_social AS "Empresa",
       {O.tax_id_pretty('cnpj')} AS "CNPJ", {O.brl('valor_parcelado')} AS "Valor",
       dias_vida_parcelamento AS "Dias Ativo", classificacao_risco AS "Risco", gerfe AS "GERFE"
FROM alerts""", "P2/F2/F3: alert list")
def _p2a(t):
    return RP.alerts_report(t.alerts)


@q("p2_recovery_report", W("recovery") + f"""
SELECT tipo_adesao AS "Tipo Adesão", origem_debito AS "Origem", cd_status AS "Cód Status",
       desc_status AS "Status", count(*) AS "Quantidade", count(DISTINCT cnpj_raiz) AS "Empresas",
       {O.brl_mm(f'CAST(sum(valor_parcelado) AS {O.MONEY})')} AS "Valor Total",
       {O.avg_round1('sum(num_parcelas)', 'count(num_parcelas)')} AS "Média Parcelas"
FROM recovery GROUP BY tipo_adesao, origem_debito, cd_status, desc_status""", "P2/F4: recovery detail table")
def _p2v(t):
    return RP.recovery_report(RV.recovery_summary(t.recovery))


@q("p2_company_history_report", W("agreements", "scores") + f"""
SELECT num_parcelamento AS "Nº Parcelamento", categoria_parcelamento AS "Categoria", desc_status AS "Status",
       {O.brl('valor_parcelado')} AS "Valor", num_parcelas AS "Parcelas", dt_pedido AS "Data Pedido",
       faixa_parcelas AS "Faixa"
FROM agreements WHERE cnpj_raiz = {_TOP_COMPANY}""", "P2/K10/F3: the company's agreement history")
def _p2h(t):
    return RP.company_history_report(LK.company_agreements(_picked(t).agreements))


@q("j5_risk_probability_lookup", W("scores") + """
SELECT s.cnpj_raiz, s.classificacao_risco, coalesce(d.probabilidade, CAST(0.00 AS DECIMAL(3,2))) AS probabilidade
FROM scores s LEFT JOIN (VALUES ('BAIXO', CAST(0.85 AS DECIMAL(3,2))), ('MÉDIO', CAST(0.65 AS DECIMAL(3,2))),
                                ('ALTO', CAST(0.40 AS DECIMAL(3,2))), ('CRÍTICO', CAST(0.20 AS DECIMAL(3,2))))
          d(classificacao_risco, probabilidade) ON d.classificacao_risco = s.classificacao_risco""",
   "J5: dictionary lookup with default (broadcast dim + coalesce)")
def _j5(t):
    from tranche.functions import dims
    return dims.lookup_with_default(t.scores.select("cnpj_raiz", "classificacao_risco"),
                                    dims.risk_probability(t.spark), "classificacao_risco",
                                    "probabilidade", "0.00")


# ---------------------------------------------------------------------------
# Risk model (M): the fit is not SQL-expressible.  The model of one version of the
# sources is fitted once, kept in the shared folder and, by application, in memory.
# ---------------------------------------------------------------------------
_MODELS: dict = {}


def trained_model(t: Tables, scored: bool = False):
    """The model of ``t``'s input; ``scored``: the companies are read again after a fit."""
    from tranche.operators import model as M
    from tranche.plans.builds import source_version
    from tranche.session import ensure_checkpoint_dir
    version = repr((source_version(t.spark, t.sf_dir), t.params))
    key = (t.spark.sparkContext.applicationId, version)
    if key not in _MODELS:
        root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/models"
        if scored and not M.is_kept(t.spark, root, version):
            t.keep("companies")                    # read by the fit and by the scoring
        _MODELS[key] = M.fit_or_load(t.companies, root, version)
    return _MODELS[key]


def _predictions(t: Tables):
    from tranche.operators import model as M
    return M.score_companies(trained_model(t, scored=True), CO.with_scores(t.companies))


@q("m2_clean_training_frame", W("ml_frame") + "SELECT * FROM ml_frame WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in C.ML_FEATURES + [C.ML_LABEL]), "M2/P13: training rows without nulls")
def _m2(t):
    from tranche.operators import model as M
    return M.clean_training(M.training_frame(t.companies))


@q("m4_stratified_split", W("ml_frame") + f"""
SELECT *, row_number() OVER (PARTITION BY {C.ML_LABEL} ORDER BY md5(cnpj_raiz || ':42'))
          <= floor(count(*) OVER (PARTITION BY {C.ML_LABEL}) * CAST(0.2 AS DOUBLE)) AS is_test
FROM ml_frame WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in C.ML_FEATURES + [C.ML_LABEL]),
   "M4: deterministic stratified split, exactly 20 % of each class")
def _m4(t):
    from tranche.operators import model as M
    return M.stratified_split(M.clean_training(M.training_frame(t.companies)))


_SCORING = [c for c in C.ML_FEATURES if c != "flag_simples_nacional"]


@q("p14_m11_absent_feature", W("companies") + "SELECT cnpj_raiz, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SCORING)
   + ", CAST(0 AS DOUBLE) AS flag_simples_nacional FROM companies",
   "P14/M11: the scoring frame of a company table that lacks a feature (0)")
def _p14(t):
    from tranche.operators import model as M
    return M.scoring_frame(t.companies.select("cnpj_raiz", *_SCORING)).select("cnpj_raiz", *C.ML_FEATURES)


@q("m8_m9_model_metrics", None, "M5-M9: fit GBT pipeline, accuracy and ROC-AUC on the test split")
def _m8(t):
    from tranche.operators import model as M
    return M.metrics_frame(trained_model(t), t.spark)


@q("m10_feature_importance", None, "M10/K17: feature importances, ascending")
def _m10(t):
    from tranche.operators import model as M
    return M.importance_frame(trained_model(t), t.spark)


@q("m11_company_predictions", None, "M7/M11/M14: probability for every company")
def _m11(t):
    return _predictions(t)


@q("m12_top50_probability", None, "M12/K18/P2: top 50 by cancellation probability, display table")
def _m12(t):
    from tranche.operators import model as M
    return RP.ml_top_report(M.top_probability(_predictions(t), 50))


@q("m13_probability_histogram", None, "M13/A17: 50-bin probability histogram")
def _m13(t):
    from tranche.operators import model as M
    return M.probability_histogram(_predictions(t), 50)


# ---------------------------------------------------------------------------
# Bundles (S3, S4) and the stored build (S8): each frame's rows and money
# ---------------------------------------------------------------------------
def _bundle(frames: dict[str, DataFrame], money: dict[str, str]) -> DataFrame:
    """(quadro, linhas, valor): of each frame its rows and the sum of a money column."""
    rows = [df.agg(F.count(F.lit(1)).alias("linhas"), F.coalesce(F.sum(money[name]), F.lit(0)).cast("decimal(28,2)").alias("valor"))
            .select(F.lit(name).alias("quadro"), "linhas", "valor") for name, df in frames.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _bundle_sql(frames: dict[str, str], money: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS quadro, count(*) AS linhas, CAST(coalesce(sum({money[name]}), 0) AS DECIMAL(28,2)) AS valor "
                              f"FROM ({sql})" for name, sql in frames.items())


_COMPANY_MONEY = {"empresa": "valor_total_parcelado", "score": "valor_ativos", "parcelamentos": "valor_parcelado",
                  "alertas": "valor_parcelado", "expectativa": "valor_esperado_12_meses"}


@q("s4_company_bundle", W("companies", "scores", "agreements", "alerts", "receipts") + _bundle_sql(
    {name: f"SELECT * FROM {table} WHERE cnpj_raiz = {_TOP_COMPANY}" for name, table in (
        ("empresa", "companies"), ("score", "scores"), ("parcelamentos", "agreements"), ("alertas", "alerts"), ("expectativa", "receipts"))},
    _COMPANY_MONEY), "S4/P4/J2: the five frames of a company's page, loaded by its literal key")
def _s4(t):
    from tranche.plans.dashboard import load_company
    (key,) = LK.pick_companies(t.scores, 1)
    return _bundle(load_company(t, key), _COMPANY_MONEY)


_OVERVIEW_MONEY = {"resumo": "valor_total_parcelado", "metricas_gerfe": "valor_total", "metricas_ges": "valor_total", "serie_temporal": "valor_total",
                   "analise_faixas": "valor_total", "analise_cnae": "valor_total", "programas_especiais": "valor_total",
                   "alertas": "valor_parcelado", "empresas_score": "valor_ativos", "recuperamais_resumo": "valor_total",
                   "expectativa_resumo": "total_12_meses"}


@q("s3_overview_bundle", W("summary", "region", "sector", "series", "band", "activity", "programme", "alerts", "scores", "recovery", "receipts")
   + _bundle_sql({
       "resumo": "SELECT * FROM summary", "metricas_gerfe": "SELECT * FROM region", "metricas_ges": "SELECT * FROM sector",
       "serie_temporal": "SELECT * FROM series", "analise_faixas": "SELECT * FROM band",
       "analise_cnae": "SELECT * FROM activity ORDER BY valor_total DESC, descricao_secao LIMIT 20",
       "programas_especiais": "SELECT * FROM programme",
       "alertas": "SELECT * FROM alerts ORDER BY prioridade, valor_parcelado DESC, num_parcelamento LIMIT 100",
       "empresas_score": "SELECT * FROM scores ORDER BY score_risco_final DESC, cnpj_raiz LIMIT 500",
       "recuperamais_resumo": "SELECT tipo_adesao, origem_debito, cd_status, desc_status, sum(valor_parcelado) AS valor_total FROM recovery GROUP BY ALL",
       "expectativa_resumo": "SELECT risco_empresa, sum(valor_esperado_12_meses) AS total_12_meses FROM receipts GROUP BY ALL"},
       _OVERVIEW_MONEY), "S3: the eleven frames of the overview")
def _s3(t):
    from tranche.plans.dashboard import load_aggregates
    return _bundle(load_aggregates(t), _OVERVIEW_MONEY)


_KEYED = {"agreements", "company_rollup", "companies", "scores", "receipts", "recovery", "alerts"}
_BUILT = ["agreements", "companies", "scores", "receipts", "series", "region", "sector", "activity", "band", "programme",
          "recovery", "alerts", "summary"]


@q("s8_stored_build", W(*_BUILT) + " UNION ALL ".join(
    f"SELECT '{n}' AS tabela, count(*) AS linhas, " + ("count(*) FILTER (WHERE cnpj_raiz IS NULL)" if n in _KEYED else "NULL")
    + f" AS sem_empresa FROM {n}" for n in _BUILT), "S8/S9/S10: the stored build, by what its writes counted")
def _s8(t):
    import uuid
    from tranche.plans.builds import Store
    from tranche.session import ensure_checkpoint_dir
    store = Store(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    counts = [row for row in store.refresh(t.sf_dir, t.params).counts() if row[0] in _BUILT]      # one row a table
    return t.spark.createDataFrame(counts, "tabela string, linhas long, sem_empresa long")


# ---------------------------------------------------------------------------
# Page results over the page's filters
# ---------------------------------------------------------------------------
for _qid, _new in [("a6_risk_class_frequency", "p8_a6_filtered_class_frequency"), ("a8_risk_kpis", "p8_a8_filtered_kpis"),
                   ("a9_u2_component_means", "p8_a9_filtered_component_means")]:
    QUERIES[_new] = Query(
        (lambda fn: lambda t: fn(RK.filter_companies(t.scores, ["CRÍTICO", "ALTO"], 50.0, 100000.0)))(
            {"a6_risk_class_frequency": lambda d: AL.frequency(d, "classificacao_risco"), "a8_risk_kpis": RK.risk_kpis,
             "a9_u2_component_means": RK.component_means}[_qid]),
        _chained_sql(_qid, "scores", _RISKY), f"{QUERIES[_qid].doc}, over the filtered companies (P8)")
for _qid, _new, _key in [("a6_alert_priority_frequency", "p9_a6_filtered_priority_frequency", "desc_prioridade"),
                         ("a6_alert_type_frequency", "p9_a6_filtered_type_frequency", "tipo_alerta")]:
    QUERIES[_new] = Query(
        (lambda k: lambda t: AL.frequency(AL.filter_alerts(t.alerts, ["URGENTE", "ALTA"], ["REINCIDÊNCIA", "VALOR ELEVADO"]), k))(_key),
        _chained_sql(_qid, "alerts", _PICKED_ALERTS), f"{QUERIES[_qid].doc}, over the filtered alerts (P9)")

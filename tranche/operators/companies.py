"""B2 ``companies`` (T2) and B3 ``company_scores``.

A company is a root id; its branches may differ in full id, region or sector.
``company_rollup`` reduces T1 to one row per root and registry attributes, with
only decomposable aggregates, so a company with millions of agreements sends one
row per map task, and without string buffers, so the aggregate stays hash-based.
B2 folds those few rows to one per root: measures add up, and of each attribute
the largest value among the branches is shown.
B3 is pure column arithmetic over T2: narrow, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X


COMPANY_ATTRIBUTES = ["cnpj", "razao_social", "gerfe", "ges", "situacao_cadastral", "flag_simples_nacional"]
# registry attributes carried only in the wide rollup (grouping keys of B6, B8)
ROLLUP_ATTRIBUTES = ["cd_gerfe", "descricao_secao"]
T2_COLUMNS = [
    "cnpj_raiz", "cnpj", "razao_social", "gerfe", "ges", "situacao_cadastral",
    "total_parcelamentos", "qtd_ativos", "qtd_quitados", "qtd_cancelados", "qtd_pendentes_1a_parcela",
    "taxa_sucesso_pct", "valor_total_parcelado", "valor_ativos", "valor_medio_parcelamento",
    "media_parcelas", "media_dias_quitacao", "media_dias_ate_cancelamento",
    "dias_desde_ultimo_parcelamento", "flag_reincidente", "flag_nunca_quitou", "flag_simples_nacional",
    "classificacao_comportamento"]


def _is(code: int):
    return F.col("cd_status") == code


MEASURES = ["total_parcelamentos", "qtd_ativos", "qtd_quitados", "qtd_cancelados", "qtd_pendentes_1a_parcela",
            "_v", "_nv", "_va", "_sn", "_nn", "_sq", "_nq", "_sc", "_nc"]


def companies(agreements: DataFrame, params: C.Params = C.DEFAULT,
              rollup: DataFrame | None = None) -> DataFrame:
    """One row per ``cnpj_raiz`` (null company key excluded)."""
    r = rollup if rollup is not None else company_rollup(agreements, params)
    g = (r.where(F.col("cnpj_raiz").isNotNull()).groupBy("cnpj_raiz")
         .agg(*[F.max(c).alias(c) for c in COMPANY_ATTRIBUTES], *[F.sum(c).alias(c) for c in MEASURES],
              F.max("_last").alias("_last")))
    q, c = F.col("qtd_quitados"), F.col("qtd_cancelados")
    rate = X.success_rate(q, c)
    bad, good = params.behaviour_bad_rate, params.behaviour_good_rate
    rec = params.recidivist_cancellations
    behaviour = (F.when((c >= rec) & (rate < bad), F.lit("ALTO RISCO"))
                 .when((c >= 1) & (rate < good), F.lit("RISCO MODERADO"))
                 .when(rate >= good, F.lit("BOM PAGADOR"))
                 .otherwise(F.lit("SEM HISTÓRICO")))
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s).cast("double") / F.col(n).cast("double"))
    return g.select(
        "cnpj_raiz", "cnpj", "razao_social", "gerfe", "ges", "situacao_cadastral",
        "total_parcelamentos", "qtd_ativos", "qtd_quitados", "qtd_cancelados",
        "qtd_pendentes_1a_parcela",
        rate.alias("taxa_sucesso_pct"),
        F.col("_v").cast(X.MONEY).alias("valor_total_parcelado"),
        F.coalesce(F.col("_va"), F.lit(0)).cast(X.MONEY).alias("valor_ativos"),
        X.money_avg(F.col("_v"), F.col("_nv")).alias("valor_medio_parcelamento"),
        mean("_sn", "_nn").alias("media_parcelas"),
        mean("_sq", "_nq").alias("media_dias_quitacao"),
        mean("_sc", "_nc").alias("media_dias_ate_cancelamento"),
        F.datediff(F.lit(params.as_of), F.col("_last")).alias("dias_desde_ultimo_parcelamento"),
        F.when(c >= rec, F.lit(1)).otherwise(F.lit(0)).alias("flag_reincidente"),
        F.when(q == 0, F.lit(1)).otherwise(F.lit(0)).alias("flag_nunca_quitou"),
        F.col("flag_simples_nacional").cast("int").alias("flag_simples_nacional"),
        behaviour.alias("classificacao_comportamento"),
    ).select(*T2_COLUMNS)


def company_rollup(agreements: DataFrame, params: C.Params = C.DEFAULT) -> DataFrame:
    """Measures per root and registry attributes, agreements without a company
    key included (so rollups by an attribute still count every agreement)."""
    days = F.datediff(F.col("dt_fim"), F.col("dt_pedido"))
    settled_days = F.when(_is(C.ST_SETTLED) & F.col("dt_fim").isNotNull(), days)
    cancel_days = F.when(_is(C.ST_CANCELLED) & F.col("dt_fim").isNotNull(), days)
    return (agreements.groupBy("cnpj_raiz", *COMPANY_ATTRIBUTES, *ROLLUP_ATTRIBUTES)
            .agg(F.count(F.lit(1)).alias("total_parcelamentos"),
                 F.count_if(_is(C.ST_ACTIVE)).alias("qtd_ativos"),
                 F.count_if(_is(C.ST_SETTLED)).alias("qtd_quitados"),
                 F.count_if(_is(C.ST_CANCELLED)).alias("qtd_cancelados"),
                 F.count_if(_is(C.ST_PENDING)).alias("qtd_pendentes_1a_parcela"),
                 F.sum("valor_parcelado").alias("_v"),
                 F.count("valor_parcelado").alias("_nv"),
                 F.sum(F.when(_is(C.ST_ACTIVE), F.col("valor_parcelado"))).alias("_va"),
                 F.sum("num_parcelas").alias("_sn"),
                 F.count("num_parcelas").alias("_nn"),
                 F.sum(settled_days).alias("_sq"), F.count(settled_days).alias("_nq"),
                 F.sum(cancel_days).alias("_sc"), F.count(cancel_days).alias("_nc"),
                 F.max("dt_pedido").alias("_last")))


# Score component steps (OURS rules, SURVEY §2.12 B3).
RECENCY_STEPS = [(90, 100.0), (180, 75.0), (365, 50.0), (720, 25.0)]
VALUE_STEPS = [(1_000_000, 100.0), (500_000, 75.0), (100_000, 50.0)]


def score_components(companies_df: DataFrame) -> dict:
    q, c = F.col("qtd_quitados"), F.col("qtd_cancelados")
    history = F.coalesce(X.rate_pct(c, q + c), F.lit(0.0))
    d = F.col("dias_desde_ultimo_parcelamento")
    recency = None
    for cut, pts in RECENCY_STEPS:
        recency = F.when(d <= cut, F.lit(pts)) if recency is None else recency.when(d <= cut, F.lit(pts))
    recency = recency.otherwise(F.lit(0.0))
    v = F.col("valor_ativos")
    value = None
    for cut, pts in VALUE_STEPS:
        value = F.when(v >= cut, F.lit(pts)) if value is None else value.when(v >= cut, F.lit(pts))
    value = value.when(v > 0, F.lit(25.0)).otherwise(F.lit(0.0))
    recid = F.when(F.col("flag_reincidente") == 1, F.lit(100.0)).otherwise(F.lit(0.0))
    behaviour = X.case_map("classificacao_comportamento", C.BEHAVIOUR_SCORE,
                           default=C.BEHAVIOUR_SCORE["SEM HISTÓRICO"])
    return {"score_historico_cancelamento": history, "score_recencia": recency,
            "score_valor_risco": value, "score_reincidencia": recid,
            "score_comportamento": behaviour}


SCORE_COLUMNS = ["cnpj_raiz", "cnpj", "razao_social", "gerfe", "total_parcelamentos", "qtd_ativos",
                 "qtd_cancelados", "valor_ativos", "taxa_sucesso_pct", "flag_reincidente",
                 "score_historico_cancelamento", "score_recencia", "score_valor_risco",
                 "score_reincidencia", "score_comportamento", "score_risco_final", "classificacao_risco"]


def company_scores(companies_df: DataFrame) -> DataFrame:
    """5 components (0-100), weighted final score and risk class."""
    return with_scores(companies_df).select(*SCORE_COLUMNS)


def with_scores(companies_df: DataFrame) -> DataFrame:
    """T2 plus the T3 score columns: a narrow projection, no join needed."""
    comp = score_components(companies_df)
    w = C.SCORE_WEIGHTS
    scored = companies_df.select("*", *[e.alias(k) for k, e in comp.items()])
    final = (F.lit(w["historico"]) * F.col("score_historico_cancelamento")
             + F.lit(w["recencia"]) * F.col("score_recencia")
             + F.lit(w["valor"]) * F.col("score_valor_risco")
             + F.lit(w["reincidencia"]) * F.col("score_reincidencia")
             + F.lit(w["comportamento"]) * F.col("score_comportamento"))
    return (scored.withColumn("score_risco_final", final)
            .withColumn("classificacao_risco", X.risk_class("score_risco_final")))

"""B6-B10 grouped metrics (region, sector, activity, band, programme) and the
views over them (A7, A10, A11, A12, A15, A16, K2, K3, K5, K14, K15, K20).

Two plans, one contract:

* keys that are registry attributes (region, sector, activity): the company
  rollup (one partial-aggregated ``groupBy`` of T1, shared with B2) is reduced to
  (group key, company), so a company with branches in several groups counts once
  in each.
* agreement-level keys (instalment band, programme): T1 itself is reduced to
  (group key, company), which collapses a hot company to one row per group.

Both then join the company's high-risk flag (one row per company on the other
side, so no fan-out and no skew) and roll up.

Either way the distinct-company count is a plain ``count`` of a per-company
level: no ``Expand``, no second distinct shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X

METRIC_COLUMNS = ["total_parcelamentos", "empresas_distintas", "qtd_ativos", "qtd_quitados",
                  "qtd_cancelados", "taxa_sucesso_pct", "valor_total", "valor_ativos",
                  "empresas_alto_risco"]

GROUP_KEYS = {
    "region": ["cd_gerfe", "gerfe"],
    "sector": ["ges"],
    "activity": ["descricao_secao"],
    "band": ["faixa_parcelas"],
    "programme": ["categoria_parcelamento"],
}


def _finish(g: DataFrame, keys: list[str]) -> DataFrame:
    return g.select(
        *keys, F.col("total_parcelamentos").cast("bigint").alias("total_parcelamentos"),
        "empresas_distintas",
        F.col("qtd_ativos").cast("bigint").alias("qtd_ativos"),
        F.col("qtd_quitados").cast("bigint").alias("qtd_quitados"),
        F.col("qtd_cancelados").cast("bigint").alias("qtd_cancelados"),
        X.success_rate(F.col("qtd_quitados"), F.col("qtd_cancelados")).alias("taxa_sucesso_pct"),
        F.coalesce(F.col("_v"), F.lit(0)).cast(X.MONEY).alias("valor_total"),
        F.coalesce(F.col("_va"), F.lit(0)).cast(X.MONEY).alias("valor_ativos"),
        "empresas_alto_risco")


def grouped_metrics(agreements: DataFrame, scores: DataFrame, keys: list[str],
                    params: C.Params = C.DEFAULT, rollup: DataFrame | None = None) -> DataFrame:
    """Grouped metrics by ``keys``; starts from the company rollup when every
    key is an attribute it carries."""
    st, v = F.col("cd_status"), F.col("valor_parcelado")
    if rollup is not None and all(k in rollup.columns for k in keys):
        per_company = (rollup.groupBy(*keys, "cnpj_raiz")
                       .agg(F.sum("total_parcelamentos").alias("_n"), F.sum("qtd_ativos").alias("_a"),
                            F.sum("qtd_quitados").alias("_q"), F.sum("qtd_cancelados").alias("_c"),
                            F.sum("_v").alias("_v"), F.sum("_va").alias("_va")))
    else:
        per_company = (agreements.groupBy(*keys, "cnpj_raiz")
                       .agg(F.count(F.lit(1)).alias("_n"),
                            F.count_if(st == C.ST_ACTIVE).alias("_a"),
                            F.count_if(st == C.ST_SETTLED).alias("_q"),
                            F.count_if(st == C.ST_CANCELLED).alias("_c"),
                            F.sum(v).alias("_v"),
                            F.sum(F.when(st == C.ST_ACTIVE, v)).alias("_va")))
    flags = scores.select("cnpj_raiz",
                          (F.col("score_risco_final") >= params.high_risk_score).alias("_hr"))
    j = per_company.join(flags, "cnpj_raiz", "left")
    g = j.groupBy(*keys).agg(
        F.sum("_n").alias("total_parcelamentos"),
        F.count("cnpj_raiz").alias("empresas_distintas"),
        F.sum("_a").alias("qtd_ativos"),
        F.sum("_q").alias("qtd_quitados"),
        F.sum("_c").alias("qtd_cancelados"),
        F.sum("_v").alias("_v"),
        F.sum("_va").alias("_va"),
        F.count_if(F.col("_hr") & F.col("cnpj_raiz").isNotNull()).alias("empresas_alto_risco"))
    return _finish(g, keys)


def region_metrics(agreements, scores, params=C.DEFAULT, rollup=None):
    """B6 / T6."""
    return grouped_metrics(agreements, scores, GROUP_KEYS["region"], params, rollup)


def sector_metrics(agreements, scores, params=C.DEFAULT, rollup=None):
    """B7 / T7."""
    return grouped_metrics(agreements, scores, GROUP_KEYS["sector"], params, rollup)


def activity_metrics(agreements, scores, params=C.DEFAULT, rollup=None):
    """B8 / T8."""
    return grouped_metrics(agreements, scores, GROUP_KEYS["activity"], params, rollup)


def band_metrics(agreements, scores, params=C.DEFAULT):
    """B9 / T9."""
    return grouped_metrics(agreements, scores, GROUP_KEYS["band"], params)


def programme_metrics(agreements, scores, params=C.DEFAULT):
    """Categories that are special programmes only."""
    a = agreements.where(F.col("categoria_parcelamento").isin(list(params.programme_categories)))
    return grouped_metrics(a, scores, GROUP_KEYS["programme"], params)


# ---------------------------------------------------------------------------
# Views over grouped metrics
# ---------------------------------------------------------------------------

def by_value_desc(metrics: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """K2/K3/K5/K6: order by total value desc (key as tie-breaker), optional top-k."""
    out = metrics.orderBy(F.col("valor_total").desc(), *[F.col(k).asc_nulls_last() for k in keys])
    return out.limit(limit) if limit else out


def by_rate(metrics: DataFrame, keys: list[str], ascending: bool = True) -> DataFrame:
    """K14 (asc) / K15, W3 (desc): order by success rate, nulls last."""
    r = F.col("taxa_sucesso_pct")
    first = r.asc_nulls_last() if ascending else r.desc_nulls_last()
    return metrics.orderBy(first, F.col("valor_total").desc(), *[F.col(k).asc_nulls_last() for k in keys])


def region_kpis(region: DataFrame) -> DataFrame:
    """A7, A10, A11, A12 over region metrics, one row.

    Best/worst region by success rate (null rates skipped); ties go to the
    larger total value, then the lower region code."""
    r, v, cd = F.col("taxa_sucesso_pct"), F.col("valor_total"), F.col("cd_gerfe")
    rated = F.when(r.isNotNull(), F.col("gerfe"))
    return region.agg(
        F.count(F.lit(1)).alias("qtd_regionais"),
        F.max_by(rated, F.when(r.isNotNull(), F.struct(r, v, -cd))).alias("melhor_gerfe"),
        F.max(r).alias("melhor_taxa_pct"),
        F.min_by(rated, F.when(r.isNotNull(), F.struct(r, -v, cd))).alias("pior_gerfe"),
        F.min(r).alias("pior_taxa_pct"),
        F.coalesce(F.sum("empresas_alto_risco"), F.lit(0)).cast("bigint").alias("empresas_alto_risco"))


def value_share(metrics: DataFrame, key: str, value: str = "valor_total") -> DataFrame:
    """Value and its share of the total per group (pie data).

    The total is a scalar subquery (one number), not a join."""
    g = metrics.where(F.col(key).isNotNull()).groupBy(key).agg(X.money_sum(value).alias(value))
    total = g.select(F.sum(value)).scalar()
    return g.select(key, value,
                    F.when(total > 0, F.col(value).cast("double") * 100.0 / total.cast("double"))
                    .alias("participacao_pct"))


def region_treemap(region: DataFrame) -> DataFrame:
    """area = value, colour = success rate, hover = active count, companies."""
    return region.select("gerfe", "valor_total", "taxa_sucesso_pct", "qtd_ativos", "empresas_distintas")


def region_options(region: DataFrame) -> DataFrame:
    """Region names for the selector, as listed (by value)."""
    return region.select("cd_gerfe", "gerfe")


def region_by_name(region: DataFrame, name: str) -> DataFrame:
    """First region row whose display name matches."""
    return region.where(F.col("gerfe") == F.lit(name)).orderBy("cd_gerfe").limit(1)

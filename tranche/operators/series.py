"""B5 ``monthly_series`` (T5) and its views.

One ``groupBy`` on the request month: the number of groups grows with time,
not with data, and every aggregate is decomposable, so the partial aggregate
collapses each map task to one row per month before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X


def monthly_series(agreements: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """T5: one row per request month.  ``categories`` filters agreements
    first (the category selector, D-4)."""
    a = agreements
    if categories:
        a = a.where(F.col("categoria_parcelamento").isin(list(categories)))
    st, cat, v = F.col("cd_status"), F.col("categoria_parcelamento"), F.col("valor_parcelado")
    g = (a.where(F.col("dt_pedido").isNotNull())
         .groupBy(F.trunc("dt_pedido", "MM").alias("periodo_pedido"))
         .agg(F.count(F.lit(1)).alias("total_parcelamentos"),
              F.count_if(st == C.ST_ACTIVE).alias("qtd_ativos"),
              F.count_if(st == C.ST_SETTLED).alias("qtd_quitados"),
              F.count_if(st == C.ST_CANCELLED).alias("qtd_cancelados"),
              F.count_if(cat == C.CAT_ICMS).alias("qtd_icms"),
              F.count_if(cat == C.CAT_DVA).alias("qtd_dva"),
              F.count_if(cat == C.CAT_DECLARED).alias("qtd_declarado"),
              F.count_if(cat == C.CAT_RECOVERY).alias("qtd_recuperamais"),
              F.sum(v).alias("_v"), F.count(v).alias("_nv"),
              F.sum(F.when(st == C.ST_SETTLED, v)).alias("_vq"),
              F.sum(F.when(st == C.ST_CANCELLED, v)).alias("_vc")))
    return g.select(
        "periodo_pedido", F.year("periodo_pedido").alias("ano_pedido"),
        "total_parcelamentos", "qtd_ativos", "qtd_quitados", "qtd_cancelados",
        "qtd_icms", "qtd_dva", "qtd_declarado", "qtd_recuperamais",
        F.coalesce(F.col("_v"), F.lit(0)).cast(X.MONEY).alias("valor_total"),
        F.coalesce(F.col("_vq"), F.lit(0)).cast(X.MONEY).alias("valor_quitado"),
        F.coalesce(F.col("_vc"), F.lit(0)).cast(X.MONEY).alias("valor_cancelado"),
        X.money_avg(F.col("_v"), F.col("_nv")).alias("ticket_medio"),
        X.success_rate(F.col("qtd_quitados"), F.col("qtd_cancelados")).alias("taxa_sucesso_pct"))


def requested_in(agreements: DataFrame, year: int) -> DataFrame:
    """Agreements requested in a year, as a range that reaches the scan of the requests' dates."""
    return agreements.where((F.col("dt_pedido") >= F.lit(f"{year:04}-01-01").cast("timestamp_ntz"))
                            & (F.col("dt_pedido") < F.lit(f"{year + 1:04}-01-01").cast("timestamp_ntz")))


def filter_year(series: DataFrame, year: int | None = None) -> DataFrame:
    """Year filter; ``None`` is the "all years" sentinel."""
    return series if year is None else series.where(F.col("ano_pedido") == year)


def year_options(series: DataFrame) -> DataFrame:
    """Sorted distinct years."""
    return series.select("ano_pedido").distinct().orderBy("ano_pedido")


def last_periods(series: DataFrame, n: int = 24) -> DataFrame:
    """Last ``n`` months (top-k by period, then ascending)."""
    return series.orderBy(F.col("periodo_pedido").desc()).limit(n).orderBy("periodo_pedido")


def series_status_long(series: DataFrame) -> DataFrame:
    """U4: counts by status, wide -> long, with the ``yyyy-MM`` label."""
    return (series.select("periodo_pedido", X.period_text("periodo_pedido").alias("periodo"),
                          F.col("qtd_ativos").alias("ATIVO"), F.col("qtd_quitados").alias("QUITADO"),
                          F.col("qtd_cancelados").alias("CANCELADO"))
            .unpivot(["periodo_pedido", "periodo"], ["ATIVO", "QUITADO", "CANCELADO"], "status", "quantidade"))


def series_category_long(series: DataFrame) -> DataFrame:
    """Monthly counts by the 4 charted categories, long form."""
    return (series.select("periodo_pedido",
                          F.col("qtd_icms").alias("ICMS"), F.col("qtd_dva").alias("DÍVIDA ATIVA"),
                          F.col("qtd_declarado").alias("DECLARADO"), F.col("qtd_recuperamais").alias("RECUPERA+"))
            .unpivot(["periodo_pedido"], ["ICMS", "DÍVIDA ATIVA", "DECLARADO", "RECUPERA+"],
                     "categoria", "quantidade"))


def series_values_long(series: DataFrame) -> DataFrame:
    """The value lines (millions, settled and cancelled), wide -> long."""
    return (series_values(series)
            .select("periodo_pedido", F.col("valor_quitado_mi").alias("QUITADO"), F.col("valor_cancelado_mi").alias("CANCELADO"))
            .unpivot(["periodo_pedido"], ["QUITADO", "CANCELADO"], "serie", "valor_mi"))


def series_values(series: DataFrame) -> DataFrame:
    """Value lines in millions and ticket in thousands (time page)."""
    return series.select(
        "periodo_pedido",
        (F.col("valor_quitado").cast("double") / 1e6).alias("valor_quitado_mi"),
        (F.col("valor_cancelado").cast("double") / 1e6).alias("valor_cancelado_mi"),
        (F.col("ticket_medio").cast("double") / 1e3).alias("ticket_medio_mil"),
        "taxa_sucesso_pct")

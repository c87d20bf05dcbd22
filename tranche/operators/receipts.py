"""B4 ``expected_receipts`` (T4) and its summaries.

Gross expectation over h months = instalment x instalments still due within h
months, for active agreements requested up to ``as_of``.  Adjusted = gross x
probability of the company's risk class.  The instalment is rounded half-up
to cents once, so gross and adjusted are exact decimals.

Each agreement needs its company's risk class: a ``lookup_join`` on
``cnpj_raiz`` (hot companies salted), after projecting the few needed columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X
from tranche.operators.skew import lookup_join

HORIZONS = (3, 12)


def months_elapsed(start, as_of):
    """Whole months from ``start`` to ``as_of`` (portable rule, no months_between)."""
    return ((F.year(as_of) - F.year(start)) * 12 + (F.month(as_of) - F.month(start))
            - F.when(F.dayofmonth(as_of) < F.dayofmonth(start), F.lit(1)).otherwise(F.lit(0)))


def receipt_filter(params: C.Params = C.DEFAULT):
    """Agreements that enter the projection: active, requested up to ``as_of``."""
    return (F.col("cd_status") == C.ST_ACTIVE) & (F.to_date("dt_pedido") <= F.lit(params.as_of))


def gross_expectation(h: int, params: C.Params = C.DEFAULT):
    """Gross value expected in the next ``h`` months for one agreement row."""
    n = F.col("num_parcelas")
    remaining = F.greatest(n - F.greatest(months_elapsed(F.col("dt_pedido"), F.lit(params.as_of)), F.lit(0)),
                           F.lit(0))
    instalment = F.when(n > 0, X.half_up_div(X.cents(F.col("valor_parcelado")), n.cast("bigint"))) \
        .otherwise(F.lit(0).cast("bigint"))
    return X.from_cents(instalment * F.least(F.lit(h), remaining))


def adjusted_expectation(gross, risk_col: str = "risco_empresa"):
    """Gross x probability of the risk class, rounded half-up to cents."""
    return (gross * X.success_probability(risk_col)).cast(X.MONEY)


def expected_receipts(agreements: DataFrame, scores: DataFrame,
                      params: C.Params = C.DEFAULT, hot: DataFrame | None = None) -> DataFrame:
    base = agreements.where(receipt_filter(params)).select(
        "num_parcelamento", "cnpj_raiz",
        *[gross_expectation(h, params).alias(f"valor_esperado_{h}_meses") for h in HORIZONS])
    risk = scores.select("cnpj_raiz", F.col("classificacao_risco").alias("risco_empresa"))
    j = lookup_join(base, risk, "cnpj_raiz", ["num_parcelamento"], params.skew, hot=hot)
    return j.select(
        "num_parcelamento", "cnpj_raiz", "risco_empresa",
        *[f"valor_esperado_{h}_meses" for h in HORIZONS],
        *[adjusted_expectation(F.col(f"valor_esperado_{h}_meses")).alias(f"valor_ajustado_risco_{h}_meses")
          for h in HORIZONS])


def receipts_summary(receipts: DataFrame) -> DataFrame:
    """A2: by risk class (null class kept as its own group)."""
    return receipts.groupBy("risco_empresa").agg(
        F.count(F.lit(1)).alias("qtd_parcelamentos"),
        X.money_sum("valor_esperado_3_meses").alias("total_3_meses"),
        X.money_sum("valor_esperado_12_meses").alias("total_12_meses"),
        X.money_sum("valor_ajustado_risco_3_meses").alias("ajustado_3_meses"),
        X.money_sum("valor_ajustado_risco_12_meses").alias("ajustado_12_meses"))


def receipts_long(summary: DataFrame) -> DataFrame:
    """Gross vs adjusted per risk class, wide -> long (3 and 12 months)."""
    cols = ["total_3_meses", "ajustado_3_meses", "total_12_meses", "ajustado_12_meses"]
    return (summary.select("risco_empresa", *[F.col(c).cast(X.MONEY) for c in cols])
            .unpivot(["risco_empresa"], cols, "tipo", "valor"))


def receipts_gap(summary_row: DataFrame) -> DataFrame:
    """P19 + F9: gross - adjusted per horizon from the executive summary, text when > 0."""
    out = []
    for h, gross, adj in ((3, "expectativa_3_meses", "expectativa_ajustada_3_meses"),
                          (12, "expectativa_12_meses", "expectativa_ajustada_12_meses")):
        g = F.coalesce(F.col(gross), F.lit(0)) - F.coalesce(F.col(adj), F.lit(0))
        out += [F.when(g > 0, g).cast(X.MONEY).alias(f"gap_{h}_meses"),
                X.gap_text(g).alias(f"gap_{h}_meses_texto")]
    return summary_row.select(*out)

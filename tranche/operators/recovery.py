"""B11 ``recovery_agreements`` (T11) and the recovery-programme views
(A1, A3, A4, A5, A7, A13, A18, K9, K13).

A1 and its re-aggregations are one ``GROUPING SETS`` pass: the grouping sets
(4 keys), (join type), (status), (origin, status) come out of a single
``Expand`` + aggregate (the grand total is a global aggregate beside it, so
it exists even on empty input), and every level gets an exact
``count(DISTINCT cnpj_raiz)`` instead of summing per-group distinct counts
(D-3).  The input is first collapsed to one row per (4 keys, company), so the
distinct shuffle moves at most one row per company and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import config as C
from tranche.functions import exprs as X

KEYS = ["tipo_adesao", "origem_debito", "cd_status", "desc_status"]
# grouping_id bit order follows KEYS (first key = most significant bit)
LEVELS = {
    "detalhe": 0,              # (tipo, origem, cd_status, desc_status)
    "tipo_adesao": 0b0111,     # (tipo)
    "status": 0b1110,          # (desc_status)
    "origem_status": 0b1010,   # (origem, desc_status)
    "total": 0b1111,           # ()
}


def recovery_predicate(params: C.Params = C.DEFAULT):
    """Recovery category, within the joining window when one is set."""
    cond = F.col("categoria_parcelamento") == C.CAT_RECOVERY
    if params.recovery_start is not None:
        cond = cond & (F.to_date("dt_pedido") >= F.lit(params.recovery_start))
    if params.recovery_end is not None:
        cond = cond & (F.to_date("dt_pedido") <= F.lit(params.recovery_end))
    return cond


def recovery_agreements(agreements: DataFrame, params: C.Params = C.DEFAULT) -> DataFrame:
    """Agreements of the recovery programme within the joining window."""
    return agreements.where(recovery_predicate(params)).select("num_parcelamento", "cnpj_raiz", "tipo_adesao", "origem_debito",
                    "cd_status", "desc_status", "valor_parcelado", "num_parcelas")


def recovery_summary(recovery: DataFrame) -> DataFrame:
    """A1: by (join type, origin, status code, status) -> count, exact distinct
    companies, value, mean instalments (1 decimal)."""
    return recovery.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("qtd"),
        F.count_distinct("cnpj_raiz").alias("empresas"),
        X.money_sum("valor_parcelado").alias("valor_total"),
        X.avg_round1(F.sum("num_parcelas"), F.count("num_parcelas")).alias("media_parcelas"))


def recovery_cube(recovery: DataFrame) -> DataFrame:
    """A1 + A3 + A4 + A5 + grand total in one grouping-sets pass."""
    per_company = recovery.groupBy(*KEYS, "cnpj_raiz").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("valor_parcelado").alias("_v"),
        F.sum("num_parcelas").alias("_sn"),
        F.count("num_parcelas").alias("_nn"))
    k = [F.col(c) for c in KEYS]
    measures = [F.sum("_n").alias("qtd"),
                F.count_distinct("cnpj_raiz").alias("empresas"),
                F.sum("_v").alias("_v"),
                F.sum("_sn").alias("_sn"),
                F.sum("_nn").alias("_nn")]
    g = per_company.groupingSets(
        [k, [k[0]], [k[3]], [k[1], k[3]]], *k
    ).agg(F.grouping_id().alias("nivel"), *measures)
    # the grand total as a global aggregate: one row even on empty input
    # (an empty grouping set inside GROUPING SETS yields no row there)
    total = per_company.agg(*measures).select(
        *[F.lit(None).cast(t).alias(c) for c, t in zip(KEYS, ["string", "string", "int", "string"])],
        F.lit(LEVELS["total"]).cast("int").alias("nivel"), "qtd", "empresas", "_v", "_sn", "_nn")
    g = g.unionByName(total.select(*g.columns))
    return g.select(
        *KEYS, F.col("nivel").cast("int").alias("nivel"), F.col("qtd").cast("bigint").alias("qtd"),
        "empresas", F.col("_v").cast(X.MONEY).alias("valor_total"),
        X.avg_round1(F.col("_sn"), F.col("_nn")).alias("media_parcelas"))


def cube_level(cube: DataFrame, level: str) -> DataFrame:
    return cube.where(F.col("nivel") == LEVELS[level])


def by_join_type(recovery: DataFrame) -> DataFrame:
    """A3: by join type (null key dropped, D-9); companies exact (D-3)."""
    per_company = (recovery.where(F.col("tipo_adesao").isNotNull()).groupBy("tipo_adesao", "cnpj_raiz")
                   .agg(F.count(F.lit(1)).alias("_n"), F.sum("valor_parcelado").alias("_v")))
    return per_company.groupBy("tipo_adesao").agg(
        F.sum("_n").cast("bigint").alias("qtd"), F.count("cnpj_raiz").alias("empresas"),
        F.sum("_v").cast(X.MONEY).alias("valor_total"))


def by_status(recovery: DataFrame) -> DataFrame:
    """A4: by status; needs no instalments, so lineitem is never read."""
    return (recovery.where(F.col("desc_status").isNotNull()).groupBy("desc_status")
            .agg(F.count(F.lit(1)).alias("qtd")))


def by_origin_status(recovery: DataFrame) -> DataFrame:
    """A5: by (origin, status); needs no instalments, so lineitem is never read."""
    return (recovery.where(F.col("origem_debito").isNotNull() & F.col("desc_status").isNotNull())
            .groupBy("origem_debito", "desc_status")
            .agg(F.count(F.lit(1)).alias("qtd"), F.sum("valor_parcelado").cast(X.MONEY).alias("valor_total")))


def recovery_kpis(recovery: DataFrame) -> DataFrame:
    """A7 + A13: totals and success rate (0 when nothing ended)."""
    st = F.col("cd_status")
    q = F.count_if(st == C.ST_SETTLED)
    c = F.count_if(st == C.ST_CANCELLED)
    return recovery.agg(
        F.count(F.lit(1)).alias("total_adesoes"),
        F.count_distinct("cnpj_raiz").alias("empresas"),
        F.coalesce(X.money_sum("valor_parcelado"), F.lit(0).cast(X.MONEY)).alias("valor_total"),
        F.coalesce(X.success_rate(q, c), F.lit(0.0)).alias("taxa_sucesso_pct"))


PIVOT_STATUS = [(C.STATUS[C.ST_ACTIVE], "qtd_ativo"), (C.STATUS[C.ST_SETTLED], "qtd_quitado"),
                (C.STATUS[C.ST_CANCELLED], "qtd_cancelado"), (C.STATUS[C.ST_PENDING], "qtd_pendente")]


def origin_status_pivot(recovery: DataFrame) -> DataFrame:
    """Grouped-bar data, origin x status counts (fixed pivot values, one pass)."""
    p = (recovery.where(F.col("origem_debito").isNotNull())
         .groupBy("origem_debito").pivot("desc_status", [s for s, _ in PIVOT_STATUS])
         .agg(F.count(F.lit(1))))
    return p.select("origem_debito", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("bigint").alias(a)
                                      for s, a in PIVOT_STATUS])


def recovery_detail(recovery: DataFrame, limit: int = 1000) -> DataFrame:
    """Largest recovery agreements (value desc, id as tie-breaker)."""
    return recovery.orderBy(F.col("valor_parcelado").desc_nulls_last(),
                            F.col("num_parcelamento").asc()).limit(limit)

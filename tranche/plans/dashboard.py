"""Dashboard-facing bundles (S3, S4, S5) and the daily build.

These mirror how the analytics are consumed: one bundle of named results for
the overview pages, one bundle per company drill-down, one frame per region
drill-down.  Every value is a lazy DataFrame; nothing runs until the caller
acts on it, and each frame is independent (one failing read does not blank
the others, D-1).

Daily build::

    python -m tranche.plans.dashboard /root/testdata/sf0.1 [root_dir]

brings the store under ``root_dir`` (default: ``store`` under the session's
``spark.checkpoint.dir``) up to date and removes builds that nobody reads.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from tranche import config as C
from tranche.operators import alerts as AL
from tranche.operators import grouped as G
from tranche.operators import lookup as LK
from tranche.operators import receipts as RC
from tranche.operators import recovery as RV
from tranche.operators import risk as RK
from tranche.operators import summary as SU
from tranche.plans.catalog import Tables


def load_aggregates(t: Tables) -> dict[str, DataFrame]:
    """S3: the overview bundle, 11 named results (listings keep their caps;
    KPIs are computed by the page functions over whole tables, D-2)."""
    return {
        "resumo": SU.load_summary(t.summary),
        "metricas_gerfe": G.by_value_desc(t.region, G.GROUP_KEYS["region"]),
        "metricas_ges": G.by_value_desc(t.sector, G.GROUP_KEYS["sector"]),
        "serie_temporal": t.series.orderBy("periodo_pedido"),
        "analise_faixas": t.band,
        "analise_cnae": G.by_value_desc(t.activity, G.GROUP_KEYS["activity"], limit=20),
        "programas_especiais": G.by_value_desc(t.programme, G.GROUP_KEYS["programme"]),
        "alertas": AL.top_alerts(t.alerts, 100),
        "empresas_score": RK.top_scores(t.scores, 500),
        "recuperamais_resumo": RV.recovery_summary(t.recovery).orderBy("tipo_adesao", "origem_debito", "cd_status"),
        "expectativa_resumo": RC.receipts_summary(t.receipts),
    }


def load_company(t: Tables, cnpj_raiz: str) -> dict[str, DataFrame]:
    """The five frames of a company drill-down.  The key is a literal
    filter (pushed into the scan); derived tables are read, or computed, for
    this company only (``Tables.for_companies``)."""
    v = t.for_companies([cnpj_raiz])
    return {
        "empresa": v.companies,
        "score": v.scores,
        "parcelamentos": LK.company_agreements(v.agreements),
        "alertas": LK.company_alerts(v.alerts),
        "expectativa": v.receipts,
    }


def load_region_agreements(t: Tables, cd_gerfe: int, limit: int = 500) -> DataFrame:
    """A region's largest agreements with the company score."""
    return t.region_agreements(cd_gerfe, limit)


def load_recovery_detail(t: Tables, limit: int = 1000) -> DataFrame:
    """S6/K13."""
    return RV.recovery_detail(t.recovery, limit)


def build(spark: SparkSession, src: str, out_dir: str | None = None,
          params: C.Params = C.DEFAULT) -> Tables:
    """The daily rebuild, T1-T13 written once in dependency order."""
    return Tables(spark, src, params).materialize(out_dir)


def main(argv: list[str]) -> int:
    from tranche.plans.builds import Store
    from tranche.session import ensure_checkpoint_dir, get_session
    if len(argv) < 2:
        print(__doc__)
        return 2
    spark = get_session(None, None)      # master and sizes as spark-submit sets them
    store = Store(spark, argv[2] if len(argv) > 2 else f"{ensure_checkpoint_dir(spark).rstrip('/')}/store")
    made = store.refresh(argv[1])
    for name, rows, nulls in made.counts():
        print(name, rows, "rows" if nulls is None else f"rows, {nulls} without a company")
    print(*made.warnings(), sep="\n")
    store.prune()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))

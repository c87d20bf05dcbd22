"""B2-B13 on the hand-made agreements of FIXTURES.md §3 (as_of 2024-06-30).

"""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tranche.config import Params, SkewParams
from tranche.operators import alerts as AL
from tranche.operators import companies as CO
from tranche.operators import grouped as G
from tranche.operators import receipts as RC
from tranche.operators import recovery as RV
from tranche.operators import series as SE
from tranche.operators import summary as SU
from tests import fixture_rows as FX

P = Params(as_of=FX.AS_OF, skew=SkewParams(rows_per_bucket=1))


@pytest.fixture(scope="module")
def built(spark):
    a = FX.agreements(spark)
    c = CO.companies(a, P)
    s = CO.company_scores(c)
    return {"a": a, "c": c, "s": s}


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


def test_companies(built):
    c = by_key(built["c"], "cnpj_raiz")
    assert set(c) == {"00000001", "00000002", "00000003", "00000004"}     # null key ignored
    one, two, three, four = c["00000001"], c["00000002"], c["00000003"], c["00000004"]
    assert one.taxa_sucesso_pct == 100.0 and one.classificacao_comportamento == "BOM PAGADOR"
    assert one.media_dias_quitacao == (31 + 366) / 2
    assert one.dias_desde_ultimo_parcelamento == 396
    assert two.qtd_cancelados == 3 and two.flag_reincidente == 1 and two.flag_nunca_quitou == 1
    assert two.taxa_sucesso_pct == 0.0 and two.classificacao_comportamento == "ALTO RISCO"
    assert two.valor_ativos == Decimal("1200000.00")
    assert three.taxa_sucesso_pct is None and three.classificacao_comportamento == "SEM HISTÓRICO"
    assert four.classificacao_comportamento == "RISCO MODERADO"
    assert four.valor_total_parcelado == Decimal("700.00")                 # null value skipped
    assert four.valor_medio_parcelamento == Decimal("700.00")


@pytest.mark.parametrize("region", [None, 7])
def test_branches_are_one_company(spark, built, region):
    """A second branch (also in another region) changes no company's counts, flags, receipts or alerts."""
    def moved(r):
        if r[0] not in (4, 6):
            return r
        r = list(r)
        r[1] = r[2] + "000200"
        if region is not None:
            r[4:6] = [region, f"R{region}"]
        return tuple(r)

    a = spark.createDataFrame([moved(r) for r in FX.rows()], FX.T1_SCHEMA)
    c = CO.companies(a, P)
    s = CO.company_scores(c)
    shown = ["cnpj", "gerfe"]
    assert c.drop(*shown).exceptAll(built["c"].drop(*shown)).count() == 0 and c.count() == 4
    assert RC.expected_receipts(a, s, P).count() == 3
    before = AL.alerts(built["a"], built["s"], P)
    assert AL.alerts(a, s, P).drop("cnpj", "gerfe").exceptAll(before.drop("cnpj", "gerfe")).count() == 0
    assert AL.alerts(a, s, P).count() == before.count()
    regions = by_key(G.region_metrics(a, s, P, CO.company_rollup(a, P)), "cd_gerfe")
    assert sum(r.total_parcelamentos for r in regions.values()) == 10
    assert regions[1].empresas_distintas == 2 and (region is None or regions[7].empresas_distintas == 1)


def test_scores(built):
    s = by_key(built["s"], "cnpj_raiz")
    assert s["00000002"].score_risco_final == pytest.approx(100.0)
    assert s["00000002"].classificacao_risco == "CRÍTICO"
    assert s["00000003"].score_risco_final == pytest.approx(30.25)
    assert s["00000003"].classificacao_risco == "BAIXO"
    assert s["00000001"].score_risco_final == pytest.approx(7.0)
    assert s["00000004"].score_risco_final == pytest.approx(46.0)
    assert s["00000004"].classificacao_risco == "MÉDIO"


def test_receipts(built):
    r = by_key(RC.expected_receipts(built["a"], built["s"], P), "num_parcelamento")
    assert set(r) == {6, 7, 10}
    assert r[6].valor_esperado_3_meses == Decimal("300000.00")
    assert r[6].valor_esperado_12_meses == Decimal("1200000.00")
    assert r[6].valor_ajustado_risco_3_meses == Decimal("60000.00")
    assert r[7].valor_esperado_3_meses == Decimal("30.00")
    assert r[7].valor_ajustado_risco_12_meses == Decimal("102.00")
    assert r[10].risco_empresa is None and r[10].valor_ajustado_risco_3_meses is None
    summary = by_key(RC.receipts_summary(RC.expected_receipts(built["a"], built["s"], P)), "risco_empresa")
    assert set(summary) == {"CRÍTICO", "BAIXO", None}                       # null group kept (A2)


def test_region_metrics(built):
    g = by_key(G.region_metrics(built["a"], built["s"], P), "cd_gerfe")
    assert g[1].total_parcelamentos == 6 and g[1].empresas_distintas == 2
    assert g[1].empresas_alto_risco == 1
    assert g[2].total_parcelamentos == 4 and g[2].empresas_distintas == 2   # null company not counted
    assert g[2].taxa_sucesso_pct == 0.0 and g[2].empresas_alto_risco == 0
    kpi = G.region_kpis(G.region_metrics(built["a"], built["s"], P)).first()
    assert kpi.melhor_gerfe == "R1" and kpi.pior_gerfe == "R2"


def test_alerts(built):
    al = by_key(AL.alerts(built["a"], built["s"], P), "num_parcelamento")
    assert set(al) == {6, 8}
    assert al[6].tipo_alerta == "REINCIDÊNCIA" and al[6].prioridade == 1 and al[6].desc_prioridade == "URGENTE"
    assert al[8].tipo_alerta == "ATRASO PAGAMENTO" and al[8].prioridade == 3
    assert al[8].dias_vida_parcelamento == 181


def test_recovery_distinct_not_additive(spark):
    rows = FX.rows()
    rows[0] = rows[0][:10] + ("RECUPERA+",) + rows[0][11:]                # company 1 in two groups
    a = spark.createDataFrame(rows, FX.T1_SCHEMA)
    cube = RV.recovery_cube(RV.recovery_agreements(a, P))
    detail = RV.cube_level(cube, "detalhe").agg(F.sum("empresas")).first()[0]
    total = RV.cube_level(cube, "total").first()
    assert detail == 3 and total.empresas == 2 and total.qtd == 5
    kpis = RV.recovery_kpis(RV.recovery_agreements(a, P)).first()
    assert kpis.taxa_sucesso_pct == pytest.approx(40.0)


def test_recovery_rate_zero_when_nothing_ended(spark):
    a = FX.agreements(spark).where(F.col("num_parcelamento") == 6)
    a = a.withColumn("categoria_parcelamento", F.lit("RECUPERA+"))
    assert RV.recovery_kpis(RV.recovery_agreements(a, P)).first().taxa_sucesso_pct == 0.0


def test_series_and_summary(built, spark):
    a, c, s = built["a"], built["c"], built["s"]
    ser = SE.monthly_series(a)
    assert ser.count() == 6
    assert ser.agg(F.sum("total_parcelamentos")).first()[0] == 9           # null date excluded
    row = SU.executive_summary(a, c, P).first()
    assert row.total_parcelamentos == 10 and row.total_empresas == 4
    assert row.total_alertas == 2 and row.alertas_urgentes == 1
    assert row.empresas_reincidentes == 1 and row.empresas_risco_critico == 1
    assert row.expectativa_3_meses == Decimal("300080.00")
    assert row.qtd_ativos + row.qtd_quitados + row.qtd_cancelados + row.qtd_pendentes_1a_parcela == 10
    cats = {r.categoria: r for r in SU.summary_categories(SU.executive_summary(a, c, P)).collect()}
    assert cats["RECUPERA+"].quantidade == 4


def test_empty_input_keeps_schema(spark, built):
    empty = built["a"].limit(0)
    c = CO.companies(empty, P)
    assert c.count() == 0 and "taxa_sucesso_pct" in c.columns
    row = SU.executive_summary(empty, c, P).first()
    assert row.total_parcelamentos == 0 and row.valor_total_parcelado == Decimal("0.00")
    assert row.taxa_sucesso_global_pct is None


def test_every_build_on_empty_input(spark, built):
    """No guard needed; empty input gives typed empty frames (one zero row
    for the global summary) that conform to the declared schemas."""
    from tranche import schemas
    empty = built["a"].limit(0)
    c = CO.companies(empty, P)
    s = CO.company_scores(c)
    out = {
        "companies": c, "scores": s,
        "receipts": RC.expected_receipts(empty, s, P),
        "series": SE.monthly_series(empty),
        "region": G.region_metrics(empty, s, P, CO.company_rollup(empty, P)),
        "band": G.band_metrics(empty, s, P),
        "recovery": RV.recovery_agreements(empty, P),
        "alerts": AL.alerts(empty, s, P),
    }
    for name, df in out.items():
        assert df.count() == 0, name
        assert schemas.check(df, name) == [], name
    total = RV.recovery_cube(out["recovery"]).where("nivel = 15").collect()      # grand total row
    assert len(total) == 1 and total[0].empresas == 0
    assert AL.frequency(out["alerts"], "tipo_alerta").count() == 0
    kpi = AL.alert_kpis(out["alerts"]).first()
    assert kpi.total_alertas == 0 and kpi.valor_em_alerta == Decimal("0.00")

"""S3/S4/S5 bundles and the stored-table build."""

from tranche.plans import dashboard as D
from tranche.plans.catalog import Tables
from tests.conftest import SF_SMALL


def test_bundles(small_tables):
    agg = D.load_aggregates(small_tables)
    assert len(agg) == 11
    assert agg["resumo"].count() == 1 and agg["empresas_score"].count() <= 500
    key = agg["empresas_score"].first()["cnpj_raiz"]
    comp = D.load_company(small_tables, key)
    assert comp["empresa"].count() == 1 and comp["score"].count() == 1
    assert comp["parcelamentos"].count() >= 1
    region = agg["metricas_gerfe"].first()["cd_gerfe"]
    assert 0 < D.load_region_agreements(small_tables, region).count() <= 500


def test_stored_build_matches_lazy(spark, tmp_path):
    stored = D.build(spark, SF_SMALL, str(tmp_path / "tables"))
    lazy = Tables(spark, SF_SMALL)
    for name in ("summary", "region", "alerts", "receipts"):
        a, b = getattr(stored, name), getattr(lazy, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_company_bundle_on_stored_tables(spark, tmp_path):
    stored = D.build(spark, SF_SMALL, str(tmp_path / "tables"))
    lazy = Tables(spark, SF_SMALL)
    key = D.load_aggregates(lazy)["empresas_score"].first()["cnpj_raiz"]
    a, b = D.load_company(stored, key), D.load_company(lazy, key)
    for name in ("empresa", "score", "parcelamentos", "alertas", "expectativa"):
        assert a[name].exceptAll(b[name]).count() == 0 and b[name].exceptAll(a[name]).count() == 0

"""Stored layouts, freshness, the build in force, readers and removal, build guards."""

import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tranche.config import Params, SkewParams
from tranche.operators import model as M
from tranche.plans.builds import Store
from tranche.plans.catalog import QUERIES, Tables
from tranche.sources import store as S
from tests.conftest import SF_MEDIUM, SF_SMALL


class Clock:
    now = 1_000_000.0

    def __call__(self):
        return self.now


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    src = tmp_path_factory.mktemp("src")
    shutil.copytree(SF_SMALL, src, dirs_exist_ok=True, copy_function=shutil.copyfile)
    return str(src)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory, source):
    """A store with one build, and its clock."""
    store = Store(spark, str(tmp_path_factory.mktemp("store")), Clock())
    store.refresh(source, buckets=4)
    return store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b) -> bool:
    a = a.select(*b.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["receipts", "alerts", "band"])
def test_company_joins_of_the_store_move_no_agreement(built, no_broadcast, name):
    """T1 and T3 are bucketed alike: B4, B12 and B9 read from the store exchange neither."""
    t = built.tables(built.current())
    del t._memo[name]
    t._stored.discard(name)
    lines = plan(getattr(t, name)).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line]
    assert scans and all("Bucketed: true" in lines[i] for i in scans)
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert not shuffles if name != "band" else len(shuffles) == 1 and "faixa_parcelas" in lines[shuffles[0]]


def test_stored_equals_lazy_with_hot_companies(spark, source, tmp_path):
    """Hot companies and rows without one are kept beside the buckets; every table is the same."""
    orders = spark.read.parquet(f"{source}/orders.parquet").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))).toPandas().astype({"o_custkey": "Int64"})
    src = tmp_path / "src"
    shutil.copytree(source, src, copy_function=shutil.copyfile)
    orders.to_parquet(src / "orders.parquet", coerce_timestamps="us")
    params = Params(skew=SkewParams(rows_per_bucket=15))
    lazy, made = Tables(spark, str(src), params), Tables(spark, str(src), params).materialize(str(tmp_path / "t"), buckets=3)
    assert made._parts["agreements"].rest is not None and made._parts["agreements"].rest.where("cnpj_raiz IS NULL").count() > 0
    seen = made.written["agreements"]["parts"]
    assert seen["agreements"]["counted"]["null_keys"] == 0 < seen["agreements_hot"]["counted"]["null_keys"]
    again = Tables.opened(spark, str(src), made.written, params)
    for name in ("agreements", "scores", "receipts", "alerts", "summary", "band", "programme"):
        assert same(getattr(made, name), getattr(lazy, name)), name
        assert same(getattr(again, name), getattr(lazy, name)), name
    hot = lazy.hot_companies.keys.first()["cnpj_raiz"]
    for key in (hot, "00000002"):
        assert same(again.for_companies([key]).receipts, lazy.for_companies([key]).receipts)
    del again._memo["receipts"]
    assert same(again.receipts, lazy.receipts)              # recomputed from the two parts


def rows_scanned(df) -> int:
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_company_lookup_reads_its_row_groups(spark, tmp_path):
    """The key is pushed; of one bucket, only row groups that can hold it are read."""
    t = Tables(spark, SF_MEDIUM).materialize(str(tmp_path / "t"), names=("agreements",), buckets=2, options={"parquet.block.size": "4096"})
    files = [f for f in os.listdir(tmp_path / "t" / "agreements") if f.endswith(".parquet")]
    groups = [pq.ParquetFile(tmp_path / "t" / "agreements" / f).metadata for f in files]
    assert len(files) == 2 and min(g.num_row_groups for g in groups) > 20
    assert all(g.row_group(0).column(g.schema.names.index("cnpj_raiz")).statistics.has_min_max for g in groups)
    key = t.agreements.where("cnpj_raiz > '00000700'").orderBy("cnpj_raiz").first()["cnpj_raiz"]
    view = t.for_companies([key]).agreements
    assert f"EqualTo(cnpj_raiz,{key})" in plan(view)
    most = max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups))
    assert 0 < view.count() <= rows_scanned(view) <= 2 * most < t.agreements.count() / 10
    absent = t.for_companies(["00000700x"]).agreements        # within the range of every bucket, in no bloom filter
    assert rows_scanned(absent) == 0


def test_region_and_year_read_their_folders(built, spark):
    t = built.tables(built.current())
    region = t.region.orderBy(F.desc("valor_total")).first()["cd_gerfe"]
    assert f"PartitionFilters: [isnotnull(cd_gerfe" in plan(t.agreements_by_region.where(F.col("cd_gerfe") == region))
    p = plan(QUERIES["p7_series_year"].spark(t))
    assert "PartitionFilters: [isnotnull(ano_pedido" in p and "(ano_pedido" in p and "= 2000)" in p
    lazy = Tables(spark, t.sf_dir)
    assert same(QUERIES["p7_series_year"].spark(t), QUERIES["p7_series_year"].spark(lazy))
    assert [tuple(r) for r in t.region_agreements(region).collect()] == [tuple(r) for r in lazy.region_agreements(region).collect()]


@pytest.mark.parametrize("qid", ["k10_company_agreements", "k11_company_alerts", "j2_company_profile", "s4_company_bundle", "j1_region_agreements",
                                 "b7_sector_metrics", "s3_overview_bundle"])
def test_queries_over_the_store(built, spark, qid):
    t = built.tables(built.current())
    assert same(QUERIES[qid].spark(t), QUERIES[qid].spark(Tables(spark, t.sf_dir)))


def test_dynamic_overwrite_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "series")
    series = Tables(spark, SF_SMALL).series
    S.write_table(series, path, ["ano_pedido"])
    before = {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("ano_")}
    S.write_table(series.where("ano_pedido = 2000").withColumn("qtd_ativos", F.lit(-1).cast("long")), path, ["ano_pedido"], dynamic=True)
    after = {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("ano_")}
    assert {d for d in before if before[d] != after[d]} == {"ano_pedido=2000"}
    got = S.read_table(spark, path, series.schema)
    assert got.columns == series.columns and got.count() == series.count()
    assert {r.ano_pedido for r in got.where("qtd_ativos = -1").select("ano_pedido").collect()} == {2000}


def test_refresh_reader_and_prune(spark, source, tmp_path):
    src = tmp_path / "src"
    shutil.copytree(source, src, copy_function=shutil.copyfile)
    clock = Clock()
    store = Store(spark, str(tmp_path / "store"), clock)
    assert store.current() is None and not store.is_fresh(str(src))
    first = store.refresh(str(src), max_age=3600, buckets=2)
    assert store.refresh(str(src), max_age=3600).build == first.build                 # young: served as it is
    clock.now += 5000
    assert store.refresh(str(src), max_age=3600).build == first.build                 # old, but no source has changed
    assert len(store._pointers()) == 2
    spark.read.parquet(f"{source}/orders.parquet").where("o_orderkey % 2 = 0").toPandas().to_parquet(src / "orders.parquet", coerce_timestamps="us")
    assert store.refresh(str(src), max_age=3600).build == first.build                 # changed, but renewed a moment ago
    clock.now += 5000
    with store.reading() as t:                                                        # a reader open during the rebuild
        n = t.agreements.count()
        second = store.refresh(str(src), max_age=3600, buckets=2)
        assert second.build != first.build and store.current().build == second.build
        assert store.prune() == [] and t.agreements.count() == n
        with store.reading() as newer:
            assert newer.agreements.count() < n
    assert store.prune() == [first.build] and store.prune() == []
    assert store.current().build == second.build and store.tables(second).agreements.count() < n
    other = Params(high_risk_score=70.0)
    assert not store.is_fresh(str(src), other)


def test_an_empty_source_is_reported_by_the_build(spark, source, tmp_path):
    src = tmp_path / "src"
    shutil.copytree(source, src, copy_function=shutil.copyfile)
    schema = pq.read_schema(f"{source}/orders.parquet")
    pq.write_table(schema.empty_table(), src / "orders.parquet")
    made = Store(spark, str(tmp_path / "store")).refresh(str(src), buckets=2)
    counts = {name: rows for name, rows, _ in made.counts()}
    assert counts["agreements"] == 0 and counts["summary"] == 1
    assert "agreements: no rows" in made.warnings() and not any(w.startswith("summary") for w in made.warnings())


def test_the_model_reads_the_store(built):
    t = built.tables(built.current())
    assert M.training_frame(t.companies).count() > 0

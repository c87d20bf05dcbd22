"""Risk model: deterministic split, metric ranges, importances, scoring all companies."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from tranche.operators import companies as CO
from tranche.operators import model as M

MP = M.ModelParams(max_iter=5, max_depth=3)


@pytest.fixture(scope="module")
def trained(small_tables):
    return M.train(small_tables.companies, MP)


def test_split_deterministic(small_tables):
    f = M.clean_training(M.training_frame(small_tables.companies))
    a = M.stratified_split(f).where("is_test").select("cnpj_raiz").collect()
    b = M.stratified_split(f).where("is_test").select("cnpj_raiz").collect()
    assert sorted(a) == sorted(b) and 0 < len(a) < f.count()


def test_metrics_in_range(trained):
    assert 0.0 <= trained.accuracy <= 1.0 and 0.0 <= trained.roc_auc <= 1.0
    assert sum(trained.importances.values()) == pytest.approx(1.0)


def test_scores_every_company(trained, small_tables):
    pred = M.score_companies(trained, CO.with_scores(small_tables.companies))
    assert pred.count() == small_tables.companies.count()
    assert pred.where((F.col("prob_cancelamento") < 0) | (F.col("prob_cancelamento") > 1)).count() == 0
    h = M.probability_histogram(pred)
    assert h.agg(F.sum("quantidade")).first()[0] == pred.count()


def test_exact_medians(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    assert M.exact_medians(df, ["x"])["x"] == 3.0


def test_save_and_load(trained, small_tables, tmp_path):
    path = str(tmp_path / "model")
    M.save(trained, path)
    loaded = M.load(path)
    frame = M.as_double_features(CO.with_scores(small_tables.companies))
    a = trained.model.transform(frame).select("cnpj_raiz", "prediction").orderBy("cnpj_raiz").collect()
    b = loaded.transform(frame).select("cnpj_raiz", "prediction").orderBy("cnpj_raiz").collect()
    assert a == b


def test_fixed_seed_reproducible(small_tables):
    mp = M.ModelParams(max_iter=3, max_depth=3)
    a, b = M.train(small_tables.companies, mp), M.train(small_tables.companies, mp)
    assert (a.accuracy, a.roc_auc, a.n_train, a.n_test) == (b.accuracy, b.roc_auc, b.n_train, b.n_test)
    assert a.importances == b.importances


def test_split_takes_exactly_a_fifth_of_each_class(spark):
    for n in (1, 4, 5, 999, 70_001):
        frame = spark.range(n).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("cnpj_raiz"), (F.col("id") % 3 == 0).cast("int").alias(M.LABEL))
        rows = M.stratified_split(frame.repartition(3)).groupBy(M.LABEL).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()
        assert sum(r["n"] for r in rows) == n and all(r["t"] == r["n"] // 5 for r in rows)


def test_medians_collect_boundedly(spark, monkeypatch):
    """A million distinct values of each of three columns; rounds bring no more than their ranges to the driver."""
    n = 1_000_000
    mixed = (F.col("id") * 7_919 % n).cast("double")
    df = spark.range(n).select(mixed.alias("even"), (F.pow(F.lit(1.00002), mixed)).alias("steep"),
                               F.when(F.col("id") % 10 != 0, (F.col("id") % 5).cast("double")).alias("few"))
    taken = []
    original = type(df).collect

    def counted(self):
        rows = original(self)
        taken.append(len(rows))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    got = M.exact_medians(df, ["even", "steep", "few"], ranges=256)
    assert max(taken) <= 3 * 2 * 256 and len(taken) <= 12
    assert got["even"] == (n - 1) / 2 and got["few"] == 2.0
    lo, hi = (r[0] for r in df.select("steep").where(F.col("steep").between(1.00002 ** 499_998.5, 1.00002 ** 500_000.5)).orderBy("steep").collect())
    assert got["steep"] == (lo + hi) / 2


def test_medians_of_odd_columns(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, None, -inf, 5.0, 1e308), (float("nan"), None, inf, 5.0, -1e308), (3.0, None, inf, 5.0, 7.0)],
                               "a double, b double, c double, d double, e double")
    assert M.exact_medians(df, list("abcde")) == {"a": 2.0, "b": None, "c": inf, "d": 5.0, "e": 7.0}


def test_metrics_against_sql_over_stored_predictions(spark, trained, small_tables, tmp_path):
    """M8, M9, M12, M13, M14 in DuckDB over the predictions as stored."""
    from tranche.operators import reports as RP
    auc = """WITH r AS (SELECT risco_cancelamento AS y, rank() OVER (ORDER BY prob_cancelamento) + (count(*) OVER (PARTITION BY prob_cancelamento) - 1) / 2.0 AS rk FROM t)
             SELECT (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
                    / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) FROM r"""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW t AS SELECT * FROM read_parquet('{trained.test_predictions.removeprefix('file:')}/*.parquet')")
    n, acc = con.sql("SELECT count(*), avg(CAST(risco_ml = risco_cancelamento AS INT)) FROM t").fetchall()[0]
    assert (n, acc) == (trained.n_test, pytest.approx(trained.accuracy))
    assert con.sql(auc).fetchall()[0][0] == pytest.approx(trained.roc_auc)
    pred = M.score_companies(trained, CO.with_scores(small_tables.companies))
    pred.write.parquet(str(tmp_path / "p"))
    con.execute(f"CREATE VIEW p AS SELECT * FROM read_parquet('{tmp_path}/p/*.parquet')")
    pred = spark.read.parquet(str(tmp_path / "p"))
    top = [r["cnpj_raiz"] for r in M.top_probability(pred, 50).collect()]
    assert top == [r[0] for r in con.sql("SELECT cnpj_raiz FROM p ORDER BY prob_cancelamento DESC, cnpj_raiz LIMIT 50").fetchall()]
    shown = [r[0] for r in RP.ml_top_report(M.top_probability(pred, 50)).select("`Prob. Cancelamento`").collect()]
    assert shown == [r[0] for r in con.sql("SELECT format('{:.1f}', prob_cancelamento * 100) || '%' FROM p ORDER BY prob_cancelamento DESC, cnpj_raiz LIMIT 50").fetchall()]
    bins = {r["bin"]: r["quantidade"] for r in M.probability_histogram(pred).collect()}
    assert bins == dict(con.sql("SELECT least(CAST(floor(prob_cancelamento * 50) AS INT), 49), count(*) FROM p GROUP BY 1").fetchall())
    bands = {r[0]: r[1] for r in pred.groupBy("faixa_probabilidade").count().collect()}
    assert bands == dict(con.sql("SELECT CASE WHEN prob_cancelamento > 0.7 THEN 'MUITO ALTO' WHEN prob_cancelamento >= 0.5 THEN 'ALTO' ELSE 'MODERADO/BAIXO' END, count(*) FROM p GROUP BY 1").fetchall())


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.5, 0), (0.9, 1), (0.9, 1), (0.2, 1)], f"p double, {M.LABEL} int").repartition(3)
    pairs = [(a, b) for a in (0.5, 0.9, 0.9, 0.2) for b in (0.1, 0.5, 0.5)]
    assert M.roc_auc(df, "p") == pytest.approx(sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs))
    assert M.roc_auc(df.where(f"{M.LABEL} = 1"), "p") is None and M.roc_auc(df.limit(0), "p") is None


def test_an_absent_feature_scores_as_zero(trained, small_tables):
    whole = CO.with_scores(small_tables.companies)
    zero = M.score_companies(trained, whole.withColumn("qtd_cancelados", F.lit(0)))
    absent = M.score_companies(trained, whole.drop("qtd_cancelados"))
    cols = ["cnpj_raiz", "prob_cancelamento", "risco_ml"]
    assert zero.select(*cols).exceptAll(absent.select(*cols)).count() == 0


def test_a_bounded_fit(small_tables):
    """The bound holds for each class; the rows are those of the smallest hashes, whatever the partitions."""
    frame = M.clean_training(M.training_frame(small_tables.companies))
    mp = M.ModelParams(max_iter=3, max_depth=3, max_rows_per_class=15)
    got = M.bounded_sample(frame, mp).groupBy(M.LABEL).count().collect()
    assert all(r["count"] == min(15, frame.where(f"{M.LABEL} = {r[M.LABEL]}").count()) for r in got)
    assert sorted(M.bounded_sample(frame.repartition(7), mp).collect()) == sorted(M.bounded_sample(frame, mp).collect())
    small, large = M.train(small_tables.companies, mp), M.train(small_tables.companies, MP)
    assert small.n_fitted <= 30 < large.n_fitted and small.n_test == large.n_test


def test_the_fit_reads_every_training_row(spark):
    """More than a million training rows of one class; the default parameters leave none out."""
    risky = F.col("id") % 100 == 0
    companies = spark.range(1_300_000).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("cnpj_raiz"),
        *[(F.col("id") % (k + 5)).cast(t).alias(c) for k, (c, t) in enumerate(zip(M.M1_COLUMNS[1:-1], _COMPANY_TYPES[1:-1], strict=True))],
        F.when(risky, "ALTO RISCO").otherwise("BOM PAGADOR").alias("classificacao_comportamento"))
    companies = companies.withColumn("total_parcelamentos", F.lit(2)).withColumn("qtd_ativos", F.lit(1))
    tm = M.train(companies, M.ModelParams(max_iter=1, max_depth=1))
    assert tm.n_train + tm.n_test == 1_300_000 and tm.n_fitted == tm.n_train == 1_040_000


def test_models_are_kept_by_the_version_of_their_input(spark, tmp_path, monkeypatch):
    from tests.conftest import SF_SMALL
    from tranche.plans.builds import source_version
    from tranche.plans.tables import Tables
    src = tmp_path / "src"
    shutil.copytree(SF_SMALL, src, copy_function=shutil.copyfile)
    fits, train = [], M.train
    monkeypatch.setattr(M, "train", lambda *a: fits.append(1) or train(*a))
    get = lambda: M.fit_or_load(Tables(spark, str(src)).companies, str(tmp_path / "models"), source_version(spark, str(src)), MP)
    a, b = get(), get()
    assert len(fits) == 1 and (a.accuracy, a.roc_auc, a.importances) == (b.accuracy, b.roc_auc, b.importances)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderkey % 3 != 0").toPandas()
    orders.to_parquet(src / "orders.parquet", coerce_timestamps="us")
    assert get().n_train < a.n_train and len(fits) == 2


def _company_rows(n=60):
    """T2 rows of ``n`` companies, every third risky and with active agreements."""
    for i in range(n):
        bad = i % 3 == 0
        yield (f"{i:08d}", 3 + i % 4, 2 if bad else i % 2, 2 if bad else 0, i % 5, 0, 10.0 + i, 1000.0 * i, 100.0 * i, 6.0, 30.0, 15.0, 40 + i,
               int(bad), int(i % 5 == 0), i % 2, "ALTO RISCO" if bad else "BOM PAGADOR")


_COMPANY_TYPES = ["string", "long", "long", "long", "long", "long", *["double"] * 6, "int", "int", "int", "int", "string"]


def test_training_builds_its_frame_once(spark):
    """The companies pass once through what builds them, though split, sample and fit read them several times."""
    rows, read = list(_company_rows()), spark.sparkContext.accumulator(0)
    made = spark.sparkContext.parallelize(rows, 2).map(lambda r: (read.add(1), r)[1])
    companies = spark.createDataFrame(made, ", ".join(f"{c} {t}" for c, t in zip(M.M1_COLUMNS, _COMPANY_TYPES, strict=True)))
    tm = M.train(companies, M.ModelParams(max_iter=1, max_depth=2))
    assert read.value == len(rows) and tm.n_train + tm.n_test == len(rows)


def _star(folder):
    """Forty customers, twelve orders each, a line or two an order."""
    con = duckdb.connect()
    for name, rows in {
        "region": "SELECT 1 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT 1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey",
        "customer": "SELECT i AS c_custkey, 'C' || i AS c_name, 1 AS c_nationkey, CAST(i % 7 - 2 AS DOUBLE) AS c_acctbal, 'S' AS c_mktsegment FROM range(1, 41) r(i)",
        "orders": """SELECT i AS o_orderkey, i % 40 + 1 AS o_custkey, CASE WHEN i % 3 = 0 THEN 'F' WHEN i % 40 < 20 THEN 'P' ELSE 'O' END AS o_orderstatus,
                     CAST(i * 10 AS DOUBLE) AS o_totalprice, TIMESTAMP '2000-01-01' + INTERVAL (i) DAY AS o_orderdate, (i % 5 + 1) || '-X' AS o_orderpriority
                     FROM range(1, 481) r(i)""",
        "lineitem": "SELECT i % 480 + 1 AS l_orderkey, TIMESTAMP '2002-01-01' + INTERVAL (i) DAY AS l_shipdate FROM range(700) r(i)",
    }.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_scoring_after_a_fit_does_not_build_the_companies_again(spark, tmp_path, monkeypatch):
    from tranche.plans import catalog
    from tranche.plans.tables import Tables
    train = M.train
    monkeypatch.setattr(M, "train", lambda companies, mp: train(companies, M.ModelParams(max_iter=1, max_depth=2)))
    src = _star(tmp_path)
    for qid in ("m11_company_predictions", "m12_top50_probability"):
        monkeypatch.setattr(catalog, "_MODELS", {})
        monkeypatch.setattr(M, "kept_at", lambda *_, root=str(tmp_path / qid): root, raising=False)
        found = catalog.QUERIES[qid].spark(Tables(spark, src))
        assert not [f for f in found.inputFiles() if f.startswith(f"file://{src}/") and "lineitem" in f]
        again = catalog.QUERIES[qid].spark(Tables(spark, src))              # the model is kept: nothing is written
        assert [f for f in again.inputFiles() if "lineitem" in f] and found.count() == 40
        assert found.exceptAll(again).count() == 0

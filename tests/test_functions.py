"""Scalar functions F1-F14 on the FIXTURES.md values, and exact money helpers."""

from decimal import Decimal

from pyspark.sql import functions as F

from tranche.functions import exprs as X


def one(spark, expr, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("o")).first()["o"]


def test_f1_normalize(spark):
    assert one(spark, X.normalize_tax_id, None, "string") is None
    assert one(spark, X.normalize_tax_id, " 12.345.678/0001-95 ", "string") == "12345678000195"
    assert one(spark, X.normalize_tax_id, "123", "string") == "00000000000123"
    assert one(spark, X.normalize_tax_id, "123456789012345", "string") == "123456789012345"


def test_f2_format(spark):
    assert one(spark, X.format_tax_id, "12345678000195", "string") == "12.345.678/0001-95"
    assert one(spark, X.format_tax_id, "123456789012345", "string") == "123456789012345"


def test_f3_brl(spark):
    assert one(spark, X.format_brl, None, "double") == "R$ 0,00"
    assert one(spark, X.format_brl, 1234567.891, "double") == "R$ 1.234.567,89"
    assert one(spark, X.format_brl, 0.125, "double") == "R$ 0,12"
    assert one(spark, X.format_brl, -5.0, "double") == "R$ -5,00"


def test_f4_f5_scaled(spark):
    assert one(spark, X.format_brl_millions, None, "double") == "R$ 0,00 MM"
    assert one(spark, X.format_brl_billions, None, "double") == "R$ 0,00 Bi"
    assert one(spark, X.format_brl_millions, 2500000.0, "double") == "R$ 2,50 MM"
    assert one(spark, X.format_brl_billions, 3e9, "double") == "R$ 3,00 Bi"


def test_f6_pct_half_even_like_python(spark):
    for v, want in [(0.25, "0.2%"), (12.25, "12.2%"), (12.35, "12.3%"), (1234.25, "1234.2%")]:
        assert one(spark, X.format_pct, v, "double") == want == f"{v:.1f}%"


def test_f7_int(spark):
    assert one(spark, X.format_int, 1234567.9, "double") == "1,234,567"


def test_f13_risk_edges(spark):
    got = [one(spark, X.risk_class, v, "double") for v in (39.99, 40.0, 59.99, 60.0, 79.5, 80.0)]
    assert got == ["BAIXO", "MÉDIO", "MÉDIO", "ALTO", "ALTO", "CRÍTICO"]
    assert one(spark, X.risk_class, None, "double") is None


def test_f10_plus_30_days_keeps_time(spark):
    import datetime as dt
    v = one(spark, lambda c: X.plus_days(c, 30), dt.datetime(2024, 1, 31, 10, 30), "timestamp_ntz")
    assert v == dt.datetime(2024, 3, 1, 10, 30)


def test_half_up_and_money_avg(spark):
    df = spark.createDataFrame([(5, 2), (-5, 2), (7, 3), (0, 4)], "n bigint, d bigint")
    got = [r[0] for r in df.select(X.half_up_div(F.col("n"), F.col("d"))).collect()]
    assert got == [3, -3, 2, 0]
    m = spark.createDataFrame([(Decimal("0.05"), 2), (Decimal("10.00"), 3), (Decimal("1.00"), 0)],
                              "t decimal(28,2), n bigint")
    got = [r[0] for r in m.select(X.money_avg(F.col("t"), F.col("n"))).collect()]
    assert got == [Decimal("0.03"), Decimal("3.33"), None]


def test_avg_round1(spark):
    df = spark.createDataFrame([(9, 4), (7, 3)], "s bigint, n bigint")
    assert [r[0] for r in df.select(X.avg_round1(F.col("s"), F.col("n"))).collect()] == [2.3, 2.3]


def test_worked_example_adjusted_receipts(spark):
    df = spark.createDataFrame([(Decimal("100000.00"), "ALTO")], "g decimal(18,2), r string")
    got = df.select((F.col("g") * X.success_probability("r")).cast(X.MONEY)).first()[0]
    assert got == Decimal("40000.00")


def test_f12_missing_and_f14_round(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.25,)], "v double")
    assert [r[0] for r in df.select(X.is_missing("v")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(X.round1("v")).collect()][2] == 2.3

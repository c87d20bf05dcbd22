"""The salted lookup join on a key holding a third of the rows."""

from pyspark.sql import functions as F

from tranche.config import SkewParams
from tranche.operators.skew import bounded_broadcast, find_hot, hot_keys, lookup_join


def _frames(spark):
    fact = spark.range(30000).select(F.col("id").alias("row"),
                                     F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    dim = spark.range(30000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return fact, dim


def test_every_key_over_the_threshold_is_found(spark):
    fact, _ = _frames(spark)
    assert [(r.k, r._n) for r in find_hot(fact, "k", SkewParams(rows_per_bucket=1000)).collect()] == [(7, 10001)]
    assert hot_keys(fact, "k", SkewParams(rows_per_bucket=1)).count() == fact.select("k").distinct().count()
    assert find_hot(fact, "k", SkewParams(rows_per_bucket=20_000)).count() == 0


def test_hot_key_spread_and_result_unchanged(spark):
    fact, dim = _frames(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = lookup_join(fact, dim, "k", ["row"], SkewParams(rows_per_bucket=625))
        plain = fact.join(dim, "k", "left")
        assert salted.count() == 30000
        assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
        parts = (salted.where(F.col("k") == 7).groupBy(F.spark_partition_id().alias("p")).count().collect())
        plain_parts = (plain.where(F.col("k") == 7).groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert len(plain_parts) == 1                  # a plain shuffle join puts the hot key in one task
        assert len(parts) >= 8                        # salted: spread over many tasks
        assert max(r["count"] for r in parts) < 10000 / 4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_list_of_any_size_is_a_table(spark, monkeypatch):
    from tranche.operators import skew as S
    fact, dim = _frames(spark)
    fact = fact.withColumn("k", F.when(F.col("k") == 7, F.lit(7)).when(F.col("row") % 3 == 1, F.col("row") % 200 + 100))
    skew = SkewParams(rows_per_bucket=20)
    found = find_hot(fact, "k", skew)
    assert found.count() > 100 and found.inputFiles()             # stored, not a table of the driver
    plain = fact.join(dim, "k", "left")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(S, "MAX_BROADCAST_KEYS", 2)
    try:
        salted = lookup_join(fact, dim, "k", ["row"], skew, hot=found)
        assert salted.count() == 30000 and salted.exceptAll(plain.select(salted.columns)).count() == 0
        sizes = [r["count"] for r in S._with_buckets(fact, found.select("k", F.col("_n").cast("int").alias("_hot")), "k")
                 .groupBy("k", "_hot").count().where("k IS NOT NULL").collect()]
        assert len(sizes) == found.count() and max(sizes) == 10001
        parts = salted.where("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) >= 8                                        # the hottest key is spread as before
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_null_keys_are_spread(spark):
    fact, dim = _frames(spark)
    fact = fact.withColumn("k", F.when(F.col("row") % 3 != 0, F.col("k")))      # a third of the rows have no key
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = lookup_join(fact, dim, "k", ["row"], SkewParams())
        parts = salted.where("k IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert salted.count() == 30000 and len(parts) == 16 and max(r["count"] for r in parts) < 10000 / 8
        assert salted.where("k IS NULL AND v IS NOT NULL").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_buckets_grow_with_the_key(spark):
    from tranche.operators.skew import salt_buckets
    sk = SkewParams(rows_per_bucket=1000)
    df = spark.createDataFrame([(10,), (20_000,), (10_000_000,)], "n bigint")
    assert [r[0] for r in df.select(salt_buckets(df["n"], sk)).collect()] == [1, 20, 10_000]


def test_bounded_broadcast_checks_size(spark):
    small = spark.range(10)
    big = spark.range(100)
    assert "broadcast" in bounded_broadcast(small, 50)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in bounded_broadcast(big, 50)._jdf.queryExecution().logical().toString().lower()


def test_salted_path_runs_at_any_size(spark):
    from tests.conftest import SF_SMALL
    from tranche.config import Params
    from tranche.plans.catalog import Tables
    salted = Tables(spark, SF_SMALL, Params(skew=SkewParams(rows_per_bucket=8)))
    assert salted.hot_customers.count() > 10
    assert "_salt" in salted.agreements._jdf.queryExecution().analyzed().toString()

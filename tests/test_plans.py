"""
products, top-k as TakeOrderedAndProject, pruned scans."""

import pytest

from tranche.plans.catalog import QUERIES, Tables
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


SQL_QUERIES = [q for q, v in QUERIES.items() if v.sql is not None and not q.startswith(("a14", "j1", "s8"))]


@pytest.mark.parametrize("qid", SQL_QUERIES)
def test_no_python_no_cartesian(spark, qid):
    p = plan(QUERIES[qid].spark(Tables(spark, SF_SMALL)))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("qid", ["k7_top_alerts", "k8_top_scores", "k13_recovery_detail"])
def test_topk_is_take_ordered(spark, qid):
    df = QUERIES[qid].spark(Tables(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().sparkPlan().toString()


def test_scans_are_pruned(spark):
    p = plan(QUERIES["b5_monthly_series"].spark(Tables(spark, SF_SMALL)))
    # lineitem is read for the instalment count and end date only
    assert "l_extendedprice" not in p and "l_quantity" not in p


def test_group_metrics_have_no_expand(spark):
    p = plan(QUERIES["b6_region_metrics"].spark(Tables(spark, SF_SMALL)))
    assert "Expand" not in p


@pytest.mark.parametrize("qid", ["b1_agreements", "b2_companies", "b3_company_scores", "b4_expected_receipts",
                                 "b5_monthly_series", "b6_region_metrics", "b9_band_metrics", "b12_alerts",
                                 "b13_executive_summary", "a1_recovery_grouping_sets"])
def test_hash_aggregates_only(spark, qid):
    """Aggregates over agreements are hash-based; only the fold of a company's
    few branches, over the rollup's rows, compares strings and so sorts."""
    p = plan(QUERIES[qid].spark(Tables(spark, SF_SMALL)))
    assert all("max(razao_social" in line for line in p.splitlines() if "SortAggregate" in line)


def test_series_skips_unused_joins(spark):
    """Series needs no lineitem or customer column: both joins are gone."""
    p = plan(QUERIES["b5_monthly_series"].spark(Tables(spark, SF_SMALL)))
    assert "lineitem" not in p and "customer" not in p


def jobs_of(spark, build) -> int:
    """Spark jobs that ``build`` starts."""
    sc, group = spark.sparkContext, f"jobs-{id(build)}"
    sc.setJobGroup(group, "counted")
    try:
        build()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setJobGroup("other", "not counted")


@pytest.mark.parametrize("qid, most", [("b1_agreements", 2), ("b2_companies", 2), ("b4_expected_receipts", 4), ("b12_alerts", 4),
                                       ("k15_region_ranking", 2), ("b5_monthly_series", 0), ("b1_agreements_salted", 4)])
def test_planning_starts_few_jobs(spark, qid, most):
    """Hot companies are counted once for a set of tables; nothing else runs before the action."""
    assert jobs_of(spark, lambda: QUERIES[qid].spark(Tables(spark, SF_SMALL))) <= most


def test_a_company_view_counts_no_hot_companies(spark):
    t = Tables(spark, SF_SMALL)
    view = t.for_companies(["00000001"])
    assert view.alerts.count() >= 0 and view.receipts.count() >= 0 and "hot" not in t._memo and "hot" not in view._memo


def test_company_key_reaches_the_scans(spark):
    p = plan(Tables(spark, SF_SMALL).for_companies(["00000007"]).agreements)
    assert "EqualTo(o_custkey,7)" in p and "EqualTo(c_custkey,7)" in p
    lines = next(x for x in p.splitlines() if "lineitem" in x)
    before = p[:p.index(lines)]
    assert "LeftSemi" in before                        # lines are met by the company's orders before they are grouped
    assert before.rindex("LeftSemi") > before.rindex("HashAggregate")


def test_region_top_reads_few_columns_then_few_rows(spark):
    t = Tables(spark, SF_SMALL)
    region = QUERIES["k2_regions_by_value"].spark(t).first()["cd_gerfe"]
    p = plan(t.region_agreements(region, 500))
    lines = next(x for x in p.splitlines() if "lineitem" in x)
    assert "PushedFilters: [IsNotNull(l_orderkey), " in lines or "l_orderkey" in lines.split("DataFilters")[1].split("Format")[0]


def test_year_reaches_the_scan(spark):
    p = plan(QUERIES["p7_series_year"].spark(Tables(spark, SF_SMALL)))
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in p and "LessThan(o_orderdate,2001-01-01" in p


def test_only_source_columns_go_through_the_customer_join(spark, tmp_path):
    """What T1 derives from an order is made after the join, so its texts are not shuffled for it."""
    from tests.test_model import _star
    lines = Tables(spark, _star(tmp_path)).agreements._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x and "o_custkey" in x)
    assert any("desc_status" in x for x in lines[:join]) and not any("desc_status" in x or "cnpj" in x for x in lines[join:])

"""Plan-shape assertions: pruning, pushdown, no cartesian products, bounded windows."""

import pytest

from basketry.registry import QUERIES
from scale import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    if name not in ("dq14_price_profile", "sl03_underperformers"):  # their percentiles join frames of one row
        assert "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark):
    plan = _plan(QUERIES["rv01_monthly_trend"](spark, SF_SMALL))
    # lineitem is read with only the columns the mapping needs (it has no rule on parts)
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan


def test_rfm_scores_are_bucketed_when_large(spark):
    from basketry.operators import rfm
    from basketry.registry import star_for
    df = rfm.rfm_table(star_for(spark, SF_SMALL), per_bucket=20)
    plan = _plan(df)
    # every score window is partitioned by its bucket column
    assert plan.count("Window [") >= 3
    assert "hashpartitioning(_b" in plan


@pytest.mark.parametrize("name,scans", [("rv01_monthly_trend", 1), ("rv02_top_categories", 1), ("sl01_seller_sla", 1),
                                        ("dq09_items_missing_order", 1), ("dq10_items_missing_product", 1), ("dq11_items_missing_seller", 1)])
def test_item_passes(spark, name, scans):
    """No Expand over item or order rows, and few scans of the items."""
    plan = _plan(QUERIES[name](spark, SF_SMALL)).split("== Initial Plan ==")[0]
    assert "Expand [" not in plan
    assert plan.count("lineitem.parquet") <= scans


def test_seller_facts_take_one_item_pass(spark):
    from basketry.operators import sellers
    from basketry.registry import star_for
    plan = _plan(sellers.seller_revenue(star_for(spark, SF_SMALL)))
    assert "Expand [" not in plan and plan.count("lineitem.parquet") == 1


def test_orphans_shuffle_the_child_once(spark):
    plan = _plan(QUERIES["dq09_items_missing_order"](spark, SF_SMALL)).split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(") <= 2  # the folded child, the parent; no distinct of the parent


@pytest.mark.parametrize("name", ["dq14_price_profile", "sl03_underperformers", "sl01_seller_sla", "rv01_monthly_trend"])
def test_no_job_while_building(spark, name):
    group = f"building {name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        QUERIES[name](spark, SF_SMALL)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == _listing_jobs(spark, group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _listing_jobs(spark, group):
    """Jobs of one task that only read a file's footer for its schema."""
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    return [j for j in jobs if all(tracker.getStageInfo(s) is None or tracker.getStageInfo(s).name.startswith("parquet") for s in tracker.getJobInfo(j).stageIds)]


def test_reference_date_is_part_of_the_plan(spark):
    from basketry.operators import rfm
    from basketry.registry import star_for
    plan = _plan(rfm.rfm_metrics(star_for(spark, SF_SMALL)))
    assert "Subquery" in plan or "subquery" in plan


def test_no_window_over_all_sellers(spark):
    from basketry.operators import sellers
    from basketry.registry import star_for
    plan = _plan(sellers.seller_ranking(star_for(spark, SF_SMALL), limit=10**6, per_bucket=3))
    windows = [line for line in plan.splitlines() if "Window [" in line and "_rev" in line]
    assert windows and all("_b" in line for line in windows)

"""Cross-operator invariants on the mapped test star."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import quality, revenue, rfm
from basketry.registry import star_for
from scale import SF_MID


@pytest.fixture(scope="module")
def star(spark):
    return star_for(spark, SF_MID)


def _sum(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_gmv_and_orders_agree_across_breakdowns(star):
    monthly = revenue.period_trend(star)
    totals = {
        "monthly": (_sum(monthly, "gmv"), _sum(monthly, "total_orders")),
        "state": (_sum(revenue.state_revenue(star), "total_gmv"), _sum(revenue.state_revenue(star), "total_orders")),
        "quarter": (_sum(revenue.calendar_breakdown(star), "quarterly_gmv"),
                    _sum(revenue.calendar_breakdown(star), "orders")),
        "weekday": (_sum(revenue.weekday_pattern(star), "total_gmv"),
                    _sum(revenue.weekday_pattern(star), "total_orders")),
    }
    gmvs = {round(g, 2) for g, _ in totals.values()}
    orders = {n for _, n in totals.values()}
    assert len(gmvs) == 1 and len(orders) == 1, totals
    # the running total ends at the grand total
    last = monthly.orderBy(F.col("order_month").desc()).first()
    assert round(last.cumulative_gmv, 2) == gmvs.pop()


def test_shares_sum_to_100(star):
    assert abs(_sum(quality.status_distribution(star), "pct_of_total") - 100) < 0.05
    per_cat = revenue.payment_mix(star).groupBy("category").agg(F.sum("pct_of_category_orders").alias("s"))
    assert all(abs(r.s - 100) < 0.05 for r in per_cat.collect())
    seg = rfm.rfm_segment_summary(star)
    assert abs(_sum(seg, "pct_of_customers") - 100) < 0.1
    assert abs(_sum(seg, "pct_of_revenue") - 100) < 0.1


def test_rfm_table_and_summary_agree(star):
    # no orphan customers in the test star, so the customers join drops nobody
    table = dict(rfm.rfm_table(star).groupBy("rfm_segment").count().collect())
    summary = {r.rfm_segment: r.customer_count for r in rfm.rfm_segment_summary(star).collect()}
    assert table == summary
    cells = rfm.rfm_table(star).select("r_score", "f_score", "m_score")
    for c in ("r_score", "f_score", "m_score"):
        sizes = sorted(r["count"] for r in cells.groupBy(c).count().collect())
        assert sizes[-1] - sizes[0] <= 1  # NTILE buckets differ by at most one row

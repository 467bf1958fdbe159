"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query derives the star from the driver's test tables and runs one
operator over the whole tables.  ``*_corrected`` entries are the
documented corrections of reference behaviour (see README)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.operators import charts, cohort, quality, revenue, reviews, rfm, sellers
from basketry.session import ensure_checkpoint_dir
from basketry.sources.testdata import star_from_testdata


def star_for(spark: SparkSession, sf_dir: str):
    """Mapped star of a directory; read anew for every query, so its files are never stale."""
    return star_from_testdata(spark, sf_dir)


def _pivot(variant: str, start):
    def op(star):
        return charts.retention_pivot(charts.cohort_retention_epoch(star, start=start, variant=variant))
    op.__name__ = f"retention_pivot_{variant}"
    return op


# name -> (operator, parameters); every entry runs over a whole star.
OPERATORS: dict[str, tuple[Callable, dict]] = {
    "dq01_row_counts": (quality.row_counts, {}),
    "dq02_date_range": (quality.orders_date_range, {}),
    "dq03_status_distribution": (quality.status_distribution, {}),
    "dq04_orders_null_audit": (quality.orders_null_audit, {}),
    "dq05_items_null_audit": (quality.items_null_audit, {}),
    "dq06_orders_without_payment": (quality.orders_without_payment, {}),
    "dq07_delivered_missing_date": (quality.delivered_missing_date, {}),
    "dq08_duplicate_orders": (quality.duplicate_orders, {}),
    "dq09_items_missing_order": (quality.items_missing_order, {}),
    "dq10_items_missing_product": (quality.items_missing_product, {}),
    "dq11_items_missing_seller": (quality.items_missing_seller, {}),
    "dq12_category_coverage": (quality.category_coverage, {}),
    "dq13_category_null_rate": (quality.category_null_rate, {}),
    "dq14_price_profile": (quality.price_profile, {}),
    "rv01_monthly_trend": (revenue.period_trend, {}),
    "rv01_monthly_trend_corrected": (revenue.period_trend, {"variant": "corrected"}),
    "rv02_top_categories": (revenue.category_ranking, {}),
    "rv03_payment_mix": (revenue.payment_mix, {}),
    "rv03_payment_mix_corrected": (revenue.payment_mix, {"variant": "corrected"}),
    "rv04_state_revenue": (revenue.state_revenue, {}),
    "rv04_state_revenue_corrected": (revenue.state_revenue, {"variant": "corrected"}),
    "rv05_quarterly": (revenue.calendar_breakdown, {}),
    "rv06_weekday": (revenue.weekday_pattern, {}),
    "rv06_weekday_corrected": (revenue.weekday_pattern, {"variant": "corrected"}),
    "co01_cohort_retention": (cohort.cohort_retention, {}),
    "co01_cohort_retention_person": (cohort.cohort_retention, {"customer_key": "customer_unique_id"}),
    "co02_cohort_matrix": (cohort.cohort_matrix, {}),
    "co02_cohort_matrix_corrected": (cohort.cohort_matrix, {"variant": "corrected"}),
    "co03_retention_summary": (cohort.retention_summary, {}),
    "co04_repeat_rate": (cohort.repeat_rate, {}),
    "rf01_rfm_table": (rfm.rfm_table, {}),
    "rf01_rfm_table_corrected": (rfm.rfm_table, {"variant": "corrected"}),
    "rf02_rfm_segments": (rfm.rfm_segment_summary, {}),
    "rf02_rfm_segments_corrected": (rfm.rfm_segment_summary, {"variant": "corrected"}),
    "rf02_rfm_segments_person": (rfm.rfm_segment_summary, {"customer_key": "customer_unique_id"}),
    "rf03_high_value_customers": (rfm.high_value_customers, {}),
    "rf03_high_value_customers_corrected": (rfm.high_value_customers, {"variant": "corrected"}),
    "ch01_rfm4_segments": (rfm.rfm4_segment_sizes, {}),
    "ch01_rfm4_segments_corrected": (rfm.rfm4_segment_sizes, {"variant": "corrected"}),
    "ch02_cohort_epoch": (charts.cohort_retention_epoch, {}),
    "ch02_cohort_epoch_corrected": (charts.cohort_retention_epoch, {"start": None, "variant": "corrected"}),
    "ch03_retention_pivot": (_pivot("faithful", "2017-01-01"), {}),
    "ch03_retention_pivot_corrected": (_pivot("corrected", None), {}),
    "sl01_seller_sla": (sellers.seller_sla, {}),
    "sl02_seller_ranking": (sellers.seller_ranking, {}),
    "sl03_underperformers": (sellers.underperformers, {}),
    "sl04_state_delivery": (sellers.state_delivery, {}),
    "sl05_sla_trend": (sellers.sla_trend, {}),
    "rs01_score_distribution": (reviews.score_distribution, {}),
    "rs02_delay_vs_score": (reviews.delay_vs_score, {}),
    "rs02_delay_vs_score_corrected": (reviews.delay_vs_score, {"variant": "corrected"}),
    "rs03_low_score_share": (reviews.low_score_share, {}),
    "rs04_category_ratings": (reviews.category_ratings, {}),
    "rs04_category_ratings_corrected": (reviews.category_ratings, {"variant": "corrected"}),
    "rs05_seller_ratings": (reviews.seller_ratings, {}),
    "rs06_price_bucket_vs_score": (reviews.price_bucket_vs_score, {}),
    "rs07_review_trend": (reviews.review_trend, {}),
}


def run_operator(name: str, star) -> DataFrame:
    op, params = OPERATORS[name]
    return op(star, **params)


def _q(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return run_operator(name, star_for(spark, sf_dir))
    run.__name__ = name
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _q(name) for name in OPERATORS}

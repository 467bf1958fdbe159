"""Unit frames for the semantic traps of the reference SQL (one test per trap)."""

import datetime as dt
from decimal import Decimal
from itertools import product

from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.operators import reviews, rfm

T = dt.datetime


def test_segment_rules_all_125_cells(spark):
    cells = spark.createDataFrame(list(product(range(1, 6), repeat=3)), "r_score int, f_score int, m_score int")
    got = dict(cells.groupBy(rfm.segment_of(rfm.RFM5_RULES, rfm.RFM5_DEFAULT).alias("s")).count().collect())
    assert got == {"Others": 39, "Loyal Customers": 26, "At Risk": 18, "Potential Loyalists": 16,
                   "About to Sleep": 12, "Need Attention": 6, "Champions": 4, "Lost": 2,
                   "Recent Customers": 1, "Promising": 1}
    lost = cells.filter(rfm.segment_of(rfm.RFM5_RULES, rfm.RFM5_DEFAULT) == "Lost")
    assert sorted(tuple(r) for r in lost.collect()) == [(1, 1, 4), (1, 1, 5)]


def test_rfm4_rules(spark):
    cells = spark.createDataFrame(list(product(range(1, 5), repeat=2)), "r_score int, f_score int")
    seg = dict(((r.r_score, r.f_score), r.s) for r in
               cells.select("*", rfm.segment_of(rfm.RFM4_RULES, rfm.RFM4_DEFAULT).alias("s")).collect())
    assert seg[(4, 3)] == "Champions" and seg[(4, 2)] == "Loyal Customers"
    assert seg[(3, 1)] == "Potential Loyalists" and seg[(2, 4)] == "At Risk" and seg[(1, 4)] == "Lost"


def test_delay_buckets_same_day_late(spark):
    est = T(2020, 1, 10)
    rows = [(est, est), (est - dt.timedelta(seconds=1), est), (est + dt.timedelta(hours=1), est),
            (est + dt.timedelta(days=1), est), (est + dt.timedelta(days=3), est),
            (est + dt.timedelta(days=4), est), (est + dt.timedelta(days=8), est),
            (est + dt.timedelta(days=14), est), (est + dt.timedelta(days=15), est)]
    df = spark.createDataFrame(rows, "order_delivered_customer_date timestamp_ntz, "
                                     "order_estimated_delivery_date timestamp_ntz")
    faithful = [r.b for r in df.select(reviews.delay_bucket("faithful").alias("b")).collect()]
    corrected = [r.b for r in df.select(reviews.delay_bucket("corrected").alias("b")).collect()]
    assert faithful == ["On Time / Early", "On Time / Early", "Late 15+ days", "Late 1-3 days",
                        "Late 1-3 days", "Late 4-7 days", "Late 8-14 days", "Late 8-14 days",
                        "Late 15+ days"]
    assert corrected == ["On Time / Early", "On Time / Early", "Late 1-3 days", "Late 1-3 days",
                         "Late 1-3 days", "Late 4-7 days", "Late 8-14 days", "Late 8-14 days",
                         "Late 15+ days"]


def test_null_estimate_counts_on_time(spark):
    df = spark.createDataFrame([(T(2020, 1, 2), None)], "d timestamp_ntz, e timestamp_ntz")
    assert df.select(X.is_late("d", "e").alias("l")).first().l == 0


def test_day_and_month_boundaries(spark):
    df = spark.createDataFrame([(T(2020, 1, 1, 23), T(2020, 1, 2, 1), T(2020, 1, 31), T(2020, 2, 1),
                                 T(2023, 1, 1, 12))],
                               "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz, d timestamp_ntz, "
                               "sun timestamp_ntz")
    r = df.select(X.day_diff("a", "b").alias("dd"), X.month_diff("c", "d").alias("md"),
                  X.dow0("sun").alias("dow"), X.day_name("sun").alias("name"),
                  X.month_start("b").alias("m")).first()
    assert (r.dd, r.md, r.dow, r.name) == (1, 1, 0, "Sunday   ")
    assert r.m == T(2020, 1, 1)


def test_half_up_rounding_and_division_guard(spark):
    df = spark.createDataFrame([(1, 8, 0, 2010)], "a long, b long, z long, c long")
    r = df.select(X.pct("a", "b", 1).alias("p"), X.pct("a", "z", 2).alias("guard"),
                  F.round(F.col("c") / 2000.0, 2).alias("tie"),
                  X.pct(F.lit(-1), F.lit(8), 1).alias("neg")).first()
    assert r.p == 12.5 and r.guard is None and r.tie == 1.01
    assert r.neg == -12.5


def test_conditional_sum_on_empty_input_is_null(spark):
    df = spark.createDataFrame([], "x int")
    r = df.agg(X.flag_sum(F.col("x").isNull()).alias("s"), F.count(F.lit(1)).alias("n")).first()
    assert r.s is None and r.n == 0


def test_blank_category_is_not_unknown(spark):
    from basketry.operators.revenue import _category
    prods = spark.createDataFrame([(1, None), (2, ""), (3, "toys")], "product_id long, product_category_name string")
    got = {r.product_id: r.category for r in _category(prods).collect()}
    assert got == {1: "unknown", 2: "", 3: "toys"}


def test_money_is_exact(spark):
    df = spark.createDataFrame([(Decimal("0.10"),), (Decimal("0.20"),)] * 5, "p decimal(12,2)")
    assert df.agg(X.money(F.sum("p")).alias("s")).first().s == 1.5

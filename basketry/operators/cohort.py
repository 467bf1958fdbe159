"""Cohort retention: first-purchase month cohorts and monthly activity.

Orders are first reduced to one row per (customer, active month) with the
order count.  A customer with a third of all orders still yields at most
one row per calendar month, so the per-customer window that finds the
cohort month is bounded, and every later step works on those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.sources.star import Star

TS = "order_purchase_timestamp"


def customer_months(star: Star, key: str = "customer_id", cond=None) -> DataFrame:
    """(key, month, n_orders, cohort_month, period_number) for the orders matching ``cond``.

    Two shuffles: (key, month) order counts, then a per-key window over at
    most one row per calendar month.
    """
    per_month = _orders_of(star, key, cond).groupBy(key, X.month_start(TS).alias("month")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    first = F.min("month").over(Window.partitionBy(key))
    return per_month.withColumn("cohort_month", first).withColumn(
        "period_number", X.month_diff("cohort_month", "month").cast("bigint"))


def _orders_of(star: Star, key: str, cond) -> DataFrame:
    cond = X.is_valid() if cond is None else cond
    orders = star.orders.filter(cond).select("order_id", "customer_id", TS)
    if key != "customer_id":
        orders = orders.join(star.customers.select("customer_id", key), "customer_id")
    return orders.filter(F.col(key).isNotNull())


def active_months(star: Star, key: str = "customer_id", cond=None) -> DataFrame:
    """(key, cohort_month, month, period_number): one row per active month of each key.

    One shuffle on the key: the set of active months is deduplicated
    map-side, so even a key holding a third of all orders contributes at
    most one entry per calendar month.  For a person-level key the months
    are first reduced per customer_id, then joined to customers.
    """
    cond = X.is_valid() if cond is None else cond
    months = star.orders.filter(cond).select("customer_id", X.month_start(TS).alias("m"))
    if key != "customer_id":
        months = months.filter(F.col("m").isNotNull()).distinct() \
            .join(star.customers.select("customer_id", key), "customer_id")
    sets = months.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("m").alias("_months"))
    return sets.select(key, F.array_min("_months").alias("cohort_month"),
                       F.explode("_months").alias("month")) \
        .withColumn("period_number", X.month_diff("cohort_month", "month").cast("bigint"))


def _activity(star: Star, key: str = "customer_id") -> DataFrame:
    """Distinct active customers per (cohort, month), with the cohort size.

    Every customer is active exactly once in its own cohort month, so the
    size is the period-0 cell of the same (small) aggregate.
    """
    act = active_months(star, key).groupBy("cohort_month", "month", "period_number").agg(
        F.count(F.lit(1)).alias("active_customers"))
    sizes = act.filter(F.col("period_number") == 0).select(
        "cohort_month", F.col("active_customers").alias("cohort_size"))
    return act.join(sizes, "cohort_month")


def cohort_retention(star: Star, max_period: int = 12, customer_key: str = "customer_id") -> DataFrame:
    act = _activity(star, customer_key).filter(F.col("period_number").between(0, max_period))
    return act.select(
        "cohort_month", X.as_long("cohort_size").alias("cohort_size"), "period_number",
        X.as_long("active_customers").alias("active_customers"),
        X.pct("active_customers", "cohort_size", 2).alias("retention_rate_pct"),
    ).orderBy("cohort_month", "period_number")


def cohort_matrix(star: Star, periods: int = 6, variant: str = "faithful",
                  customer_key: str = "customer_id") -> DataFrame:
    """One row per cohort, one column per period 0..periods.

    Faithful: the period cells count orders (not customers) over the cohort
    size, so M0 can exceed 100.  ``variant='corrected'`` counts customers.
    """
    cm = customer_months(star, customer_key)
    weight = F.col("n_orders") if variant == "faithful" else F.lit(1)
    cells = [F.sum(F.when(F.col("period_number") == k, weight).otherwise(0)).alias(f"_c{k}")
             for k in range(periods + 1)]
    per_cohort = cm.groupBy("cohort_month").agg(
        F.sum(F.when(F.col("month") == F.col("cohort_month"), 1).otherwise(0)).alias("cohort_customers"),
        *cells)
    return per_cohort.select(
        "cohort_month", X.as_long("cohort_customers").alias("cohort_customers"),
        *[X.pct(f"_c{k}", "cohort_customers", 1).alias(f"M{k}_%") for k in range(periods + 1)],
    ).orderBy("cohort_month")


def retention_summary(star: Star, max_period: int = 12, customer_key: str = "customer_id") -> DataFrame:
    """Average / min / max cohort retention per period (cohorts active in it)."""
    act = _activity(star, customer_key).filter(F.col("period_number").between(0, max_period))
    rate = X.ratio(F.col("active_customers") * 100.0, F.col("cohort_size"))
    return act.withColumn("_rate", rate).groupBy("period_number").agg(
        F.round(F.avg("_rate"), 2).alias("avg_retention_pct"),
        F.min("_rate").alias("min_retention_pct"),
        F.max("_rate").alias("max_retention_pct"),
        X.as_long(F.countDistinct("cohort_month")).alias("cohorts_included"),
    ).orderBy("period_number")


def repeat_rate(star: Star, customer_key: str = "customer_id") -> DataFrame:
    """Customers, repeat customers, repeat rate, mean and max orders per customer."""
    rows = star.orders.filter(X.is_valid()) if customer_key == "customer_id" else _orders_of(star, customer_key, None)
    per_customer = rows.groupBy(customer_key).agg(
        F.countDistinct("order_id").alias("num_orders"))
    repeat = X.flag_sum(F.col("num_orders") > 1)
    return per_customer.agg(
        F.count(F.lit(1)).alias("total_customers"),
        repeat.alias("repeat_customers"),
        X.pct(repeat, F.count(F.lit(1)), 2).alias("repeat_purchase_rate_pct"),
        X.avg_of("num_orders").alias("avg_orders_per_customer"),
        X.as_long(F.max("num_orders")).alias("max_orders_single_customer"))

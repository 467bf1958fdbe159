"""Chart feeds: cohort retention by person id (long form) and its pivot."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.operators.cohort import active_months
from basketry.sources.star import Star

TS = "order_purchase_timestamp"
SECONDS_PER_30_DAYS = 2_592_000


def cohort_retention_epoch(star: Star, start: str | None = "2017-01-01", max_index: int = 6,
                           variant: str = "faithful") -> DataFrame:
    """Retention per (cohort month, month index) keyed by customer_unique_id.

    Faithful: the cohort month is the minimum within (person, month), i.e.
    the month itself, so every index is 0 and retention 100 %; the index is
    elapsed seconds over 30-day months, rounded.  ``corrected`` takes the
    first month per person and counts calendar months.  ``start=None``
    keeps every cohort.
    """
    key = "customer_unique_id"
    if variant == "faithful":
        # (customer, month) first, then the customers join and (person, month)
        per_customer = star.orders.filter(X.is_delivered()).groupBy(
            "customer_id", X.month_start(TS).alias("order_month")).agg(F.min(TS).alias("_first"))
        per_month = per_customer.join(star.customers.select("customer_id", key), "customer_id") \
            .groupBy(key, "order_month").agg(X.month_start(F.min("_first")).alias("cohort_month"))
        seconds = F.unix_seconds(F.col("order_month").cast("timestamp")) - \
            F.unix_seconds(F.col("cohort_month").cast("timestamp"))
        indexed = per_month.withColumn("month_index", F.round(seconds / SECONDS_PER_30_DAYS).cast("bigint"))
    else:
        indexed = active_months(star, key, X.is_delivered()).withColumnRenamed(
            "period_number", "month_index")
    # rows are unique per (person, month), so counting persons per cell is
    # COUNT(DISTINCT person); the cohort size is the index-0 cell
    retained = indexed.groupBy("cohort_month", "month_index").agg(F.count(key).alias("retained"))
    sizes = retained.filter(F.col("month_index") == 0).select(
        "cohort_month", F.col("retained").alias("cohort_size"))
    out = retained.join(sizes, "cohort_month").filter(F.col("month_index") <= max_index)
    if start is not None:
        out = out.filter(F.col("cohort_month") >= F.lit(start).cast("timestamp_ntz"))
    return out.select(
        "cohort_month", "month_index",
        X.pct("retained", "cohort_size", 1)
        .alias("retention_rate"),
    ).orderBy("cohort_month", "month_index")


def retention_pivot(long: DataFrame, max_index: int = 6) -> DataFrame:
    """Rows = cohort month as 'yyyy-MM', columns '0'..'max_index' = retention rate."""
    return long.groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort_month")) \
        .pivot("month_index", list(range(max_index + 1))).agg(F.first("retention_rate")) \
        .orderBy("cohort_month")

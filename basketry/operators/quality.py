"""Data-quality audits: counts, ranges, null audits, orphans, duplicates, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.plans import ordering as O
from basketry.sources.star import STAR_TABLES, Star


def row_counts(star: Star) -> DataFrame:
    """COUNT(*) of every star table, largest first."""
    parts = [star.table(name).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count") for name in STAR_TABLES]
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("row_count").desc(), "table_name")


def date_range(df: DataFrame, ts: str = "order_purchase_timestamp", key: str = "order_id",
               entity: str = "order") -> DataFrame:
    """Earliest / latest instant, day span and distinct key count (no filter)."""
    return df.agg(
        F.min(ts).alias(f"earliest_{entity}"), F.max(ts).alias(f"latest_{entity}"),
        X.as_long(X.day_diff(F.min(ts), F.max(ts))).alias("date_span_days"),
        X.as_long(F.countDistinct(key)).alias(f"total_{entity}s"))


def orders_date_range(star: Star) -> DataFrame:
    return date_range(star.orders)


def value_distribution(df: DataFrame, column: str, count_name: str = "cnt") -> DataFrame:
    """Rows per value of ``column`` (NULL is a value) with the share of all rows.

    The share window runs over one row per distinct value (a status domain).
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
    return counts.select(
        column, count_name,
        X.pct(F.col(count_name), F.sum(count_name).over(Window.partitionBy()), 2).alias("pct_of_total"),
    ).orderBy(F.col(count_name).desc(), F.col(column).asc_nulls_last())


def status_distribution(star: Star) -> DataFrame:
    return value_distribution(star.orders, "order_status", "order_count")


def null_audit(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """COUNT(*) plus SUM(CASE WHEN c IS NULL THEN 1 ELSE 0 END) per column."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  *[X.flag_sum(F.col(c).isNull()).alias(out) for c, out in columns.items()])


ORDERS_AUDIT = {"order_id": "null_order_id", "customer_id": "null_customer_id",
                "order_status": "null_status", "order_purchase_timestamp": "null_purchase_ts",
                "order_delivered_customer_date": "null_delivered_date",
                "order_estimated_delivery_date": "null_estimated_date"}
ITEMS_AUDIT = {"order_id": "null_order_id", "product_id": "null_product_id",
               "seller_id": "null_seller_id", "price": "null_price", "freight_value": "null_freight"}


def orders_null_audit(star: Star) -> DataFrame:
    return null_audit(star.orders, ORDERS_AUDIT)


def items_null_audit(star: Star) -> DataFrame:
    return null_audit(star.order_items, ITEMS_AUDIT)


def orphans(left: DataFrame, right: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``cols`` of the rows of ``left`` whose ``key`` has no row in ``right`` (a NULL key never has one)."""
    return left.select(*dict.fromkeys([key, *cols])).join(right.select(key), key, "left_anti").select(*cols)


def orders_without_payment(star: Star) -> DataFrame:
    """Orders with no payment row, newest first."""
    cols = ["order_id", "order_status", "order_purchase_timestamp"]
    return orphans(star.orders, star.order_payments, "order_id", cols).orderBy(
        F.col("order_purchase_timestamp").desc_nulls_first(), "order_id")


def count_where(df: DataFrame, cond, name: str) -> DataFrame:
    return df.filter(cond).agg(F.count(F.lit(1)).alias(name))


def delivered_missing_date(star: Star) -> DataFrame:
    return count_where(star.orders, X.is_delivered() & F.col("order_delivered_customer_date").isNull(),
                       "delivered_missing_date")


def duplicate_keys(df: DataFrame, key: str = "order_id") -> DataFrame:
    """Keys occurring more than once (map-side partial counts, so hot keys are cheap)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)


def duplicate_orders(star: Star) -> DataFrame:
    return duplicate_keys(star.orders, "order_id")


def orphan_count(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows whose key has no parent row (NULL keys count as orphans).

    One scan of the child: it is folded to a row per key and task first (a hot
    key, NULL included, is one row a task), and an anti join needs no distinct
    parent.
    """
    counts = child.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return orphans(counts, parent, key, ["_n"]).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias(name))


def _items_missing(star: Star, parent: str, key: str, name: str) -> DataFrame:
    return orphan_count(star.order_items, star.table(parent), key, name)


def items_missing_order(star: Star) -> DataFrame:
    return _items_missing(star, "orders", "order_id", "items_missing_order")


def items_missing_product(star: Star) -> DataFrame:
    return _items_missing(star, "products", "product_id", "items_missing_product")


def items_missing_seller(star: Star) -> DataFrame:
    return _items_missing(star, "sellers", "seller_id", "items_missing_seller")


def top_values(df: DataFrame, column: str, limit: int = 20, count_name: str = "cnt") -> DataFrame:
    """Most frequent values (NULL is a value), ties broken by the value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(count_name)).orderBy(
        F.col(count_name).desc(), F.col(column).asc_nulls_last()).limit(limit)


def category_coverage(star: Star, limit: int = 20) -> DataFrame:
    return top_values(star.products, "product_category_name", limit, "product_count")


def null_rate(df: DataFrame, column: str, nulls: str = "null_rows", total: str = "total_rows") -> DataFrame:
    """Rows without a value of ``column``, all rows, and the share of the former."""
    missing = X.flag_sum(F.col(column).isNull())
    return df.agg(missing.alias(nulls), F.count(F.lit(1)).alias(total),
                  X.pct(missing, F.count(F.lit(1)), 2).alias("null_pct"))


def category_null_rate(star: Star) -> DataFrame:
    return null_rate(star.products, "product_category_name", "null_categories", "total_products")


def numeric_profile(df: DataFrame, column: str, approx: float | None = None) -> DataFrame:
    """MIN, MAX, mean, interpolated median / p95 and the count of values <= 0 of a numeric column.

    Exact percentiles come from the histogram of the values (map-side partial
    counts, one row per distinct value) by interval refinement
    (``plans.ordering.selected_percentiles``), inside the same plan: no job
    runs while the query is built and no task holds all distinct values.
    ``approx`` takes them from a mergeable quantile sketch of that rank error
    instead, in one pass over the rows.
    """
    v = F.col(column)
    if approx is not None:
        places = [O.sketch_percentile(v, q, approx) for q in (0.5, 0.95)]
    else:
        places = []
        counted = df.filter(v.isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    stats = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), X.avg_of(v).alias("mean"), X.flag_sum(v <= 0).alias("low"),
                   *[c.alias(f"p{i}") for i, c in enumerate(places)])
    median, p95 = (F.col("p0"), F.col("p1")) if places else O.selected_percentiles(counted, column, "n", [0.5, 0.95])
    return stats.select(
        F.col("lo").cast("double").alias(f"min_{column}"), F.col("hi").cast("double").alias(f"max_{column}"),
        F.col("mean").alias(f"avg_{column}"), median.cast("double").alias(f"median_{column}"),
        p95.cast("double").alias(f"p95_{column}"), F.col("low").alias(f"zero_or_neg_{column}"))


def price_profile(star: Star, approx: float | None = None) -> DataFrame:
    return numeric_profile(star.order_items, "price", approx)

"""Revenue trends and breakdowns (valid orders only).

Windows here run over aggregated rows whose count is bounded by the
calendar or by a small dimension domain (months, categories x payment
types, states), so an unpartitioned window is a cheap single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.plans.facts import by_folded, by_member, lines_of_orders, order_facts
from basketry.plans.sizing import dealt, fold, partitions_for
from basketry.plans.skew import join_splitting_hot_keys
from basketry.sources.star import Star

TS = "order_purchase_timestamp"


def period_trend(star: Star, grain: str = "month", variant: str = "faithful") -> DataFrame:
    """GMV, orders, customers, AOV, LAG growth and running GMV per period.

    ``grain`` is month, quarter, year or week.  The faithful AOV divides by
    items; ``variant='corrected'`` divides by distinct orders.  Orders are
    folded to (order, period) where the join left them, then to
    (period, customer), then to periods.
    """
    period = f"order_{grain}"
    per_order = order_facts(star).groupBy("order_id", X.period_start(TS, grain).alias(period)).agg(
        F.sum("gmv_sum").alias("gmv_sum"), F.sum("gmv_cnt").alias("gmv_cnt"),
        F.collect_set("customer_id").alias("customers"))
    per_period = by_member(per_order, [period], {"unique_customers": "customers"}, ["gmv_sum", "gmv_cnt"]).select(
        period, F.round("gmv_sum", 2).alias("_gmv"), F.col("n_orders").alias("total_orders"), "unique_customers",
        X.rounded(X.ratio(F.col("gmv_sum"), F.col("n_orders" if variant == "corrected" else "gmv_cnt")), 2).alias("aov"))
    out = trend_columns(per_period, period)
    if grain != "month":
        out = out.withColumnsRenamed({"prev_month_gmv": f"prev_{grain}_gmv", "mom_growth_pct": "growth_pct"})
    return out.orderBy(F.col(period).asc_nulls_last())


def trend_columns(monthly: DataFrame, month: str = "order_month", value: str = "_gmv") -> DataFrame:
    """Previous-period value, growth % and running total over period rows.

    ``value`` is the rounded exact amount; LAG, growth and the running sum
    all use it (one row per period, so the unpartitioned window is small).
    """
    by_month = Window.orderBy(F.col(month).asc_nulls_last())
    prev = F.lag(value).over(by_month)
    running = F.sum(value).over(by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = [c for c in monthly.columns if c not in (month, value)]
    return monthly.select(
        month,
        X.money(value).alias("gmv"),
        *[X.as_long(c).alias(c) if c in ("total_orders", "unique_customers") else c for c in rest],
        prev.cast("double").alias("prev_month_gmv"),
        X.rounded(X.ratio(F.col(value) - prev, prev) * 100, 2).alias("mom_growth_pct"),
        running.cast("double").alias("cumulative_gmv"),
    )


def _category(products: DataFrame) -> DataFrame:
    return products.select("product_id", F.coalesce("product_category_name", F.lit("unknown"))
                           .alias("category"))


def category_ranking(star: Star, limit: int = 10) -> DataFrame:
    """Top categories by revenue with share of total and two ranks, in one pass over the items.

    Products are counted by surrogate ids that the products table is read with
    (the same in every run of a task, as its file splits are).
    """
    # (order, product) rows where the order join left them
    n = partitions_for(star.order_items)
    pairs = lines_of_orders(star, X.is_valid(), "product_id", {
        "price": F.sum("price"), "n_price": F.count("price"), "freight": F.sum("freight_value")}, n=n).groupBy(
        "order_id", "product_id").agg(*[F.sum(c).alias(c) for c in ("price", "n_price", "freight")])
    products = _category(star.products).withColumn("surrogate", F.monotonically_increasing_id())
    rows = join_splitting_hot_keys(pairs, products, "product_id", hot=star.hot_keys("order_items", "product_id"), n=n)
    per_cat = by_folded(rows, ["category"], "order_id", "surrogate", ["price", "n_price", "freight"], "unique_products", n).select(
        "category", F.round("price", 2).alias("_rev"), X.rounded(X.ratio(F.col("price"), F.col("n_price")), 2).alias("avg_item_price"),
        X.rounded(X.ratio(F.col("freight"), F.col("price")) * 100, 2).alias("freight_to_revenue_pct"),
        F.col("n_orders").alias("total_orders"), "unique_products")
    everything = Window.partitionBy()
    return per_cat.select(
        "category",
        X.money("_rev").alias("total_revenue"),
        X.as_long("total_orders").alias("total_orders"),
        X.as_long("unique_products").alias("unique_products"),
        "avg_item_price", "freight_to_revenue_pct",
        X.rounded(X.ratio(F.col("_rev"), F.sum("_rev").over(everything)) * 100, 2).alias("revenue_share_pct"),
        F.rank().over(Window.orderBy(F.col("_rev").desc_nulls_first())).cast("bigint").alias("revenue_rank"),
        F.rank().over(Window.orderBy(F.col("total_orders").desc_nulls_first())).cast("bigint").alias("orders_rank"),
        "_rev",
    ).orderBy(F.col("_rev").desc_nulls_first(), F.col("category").asc_nulls_last()).limit(limit).drop("_rev")


def payment_mix(star: Star, variant: str = "faithful") -> DataFrame:
    """Payment type mix per category, at item x payment grain.

    Eager aggregation: items are reduced to (order, category) counts and
    payments to (order, type) sums before the order-level join, then the
    item x payment fan-out is applied arithmetically (count x sum), which
    equals summing over the joined rows.  ``variant='corrected'`` counts
    each payment once per (order, category) instead of once per item.
    """
    parts = partitions_for(star.order_items)
    cats = fold(join_splitting_hot_keys(star.order_items.select("order_id", "product_id"), _category(star.products), "product_id",
                                        hot=star.hot_keys("order_items", "product_id"), n=parts),
                parts, "order_id", ["category"], {"n_items": F.count(F.lit(1))})
    if variant == "corrected":
        cats = cats.withColumn("n_items", F.lit(1).cast("bigint"))
    pays = fold(star.order_payments, parts, "order_id", ["payment_type"], {
        "pv_sum": F.sum("payment_value"), "inst_sum": F.sum("payment_installments"), "inst_cnt": F.count("payment_installments")})
    valid = dealt(star.orders.filter(X.is_valid()).select("order_id"), parts, "order_id")
    facts = valid.join(cats, "order_id").join(pays, "order_id")
    n = F.col("n_items")
    mix = facts.groupBy("category", "payment_type").agg(
        F.countDistinct("order_id").alias("order_count"),
        F.round(F.sum(F.col("pv_sum") * n), 2).alias("_value"),
        X.rounded(X.ratio(F.sum(F.col("inst_sum") * n), F.sum(F.col("inst_cnt") * n)), 1)
        .alias("avg_installments"))
    per_category = Window.partitionBy("category")
    return mix.select(
        "category", "payment_type",
        X.as_long("order_count").alias("order_count"),
        X.money("_value").alias("total_payment_value"),
        "avg_installments",
        X.pct(F.col("order_count"), F.sum("order_count").over(per_category), 2)
        .alias("pct_of_category_orders"),
        "_value",
    ).orderBy(F.col("category").asc_nulls_last(), F.col("_value").desc_nulls_first()).drop("_value")


def state_revenue(star: Star, variant: str = "faithful") -> DataFrame:
    """GMV per customer state with RANK over the un-rounded sum.

    Facts are reduced per customer before the customers join (a customer
    with a huge share of orders collapses map-side); with order_id and
    customer_id as keys, summing per-customer distinct order counts equals
    counting distinct orders per state.
    """
    per_customer = order_facts(star, cols=("customer_id",)).groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("n_orders"),
        F.sum("gmv_sum").alias("gmv_sum"), F.sum("gmv_cnt").alias("gmv_cnt"))
    # a repeated customers row repeats amounts, not orders; rows of a customer are together here
    facts = per_customer.join(star.customers.select("customer_id", "customer_state"), "customer_id").groupBy(
        "customer_id", "customer_state").agg(F.max("n_orders").alias("n_orders"), F.sum("gmv_sum").alias("gmv_sum"),
                                             F.sum("gmv_cnt").alias("gmv_cnt"))
    per_state = facts.groupBy("customer_state").agg(
        F.sum("n_orders").alias("total_orders"),
        F.sum("gmv_sum").alias("_raw"),
        X.rounded(X.ratio(F.sum("gmv_sum"),
                        F.sum("n_orders") if variant == "corrected" else F.sum("gmv_cnt")), 2)
        .alias("avg_order_value"),
        F.countDistinct("customer_id").alias("unique_customers"))
    return per_state.select(
        "customer_state",
        X.as_long("total_orders").alias("total_orders"),
        X.money("_raw").alias("total_gmv"),
        "avg_order_value",
        X.as_long("unique_customers").alias("unique_customers"),
        F.rank().over(Window.orderBy(F.col("_raw").desc_nulls_first())).cast("bigint").alias("gmv_rank"),
    ).orderBy(F.col("total_gmv").desc_nulls_first(), "customer_state")


CALENDAR_FIELDS = {"year": ("yr", F.year), "quarter": ("qtr", F.quarter), "month": ("mon", F.month),
                   "week": ("wk", F.weekofyear), "weekday": ("dow", X.dow0)}


def calendar_breakdown(star: Star, fields: tuple[str, ...] = ("year", "quarter"),
                       gmv_name: str = "quarterly_gmv") -> DataFrame:
    """GMV (price + freight), distinct orders and item price per combination of calendar ``fields``."""
    parts = [CALENDAR_FIELDS[f] for f in fields]
    return order_facts(star, cols=(TS,)).groupBy(
        *[part(TS).cast("bigint").alias(name) for name, part in parts]).agg(
        X.money(F.sum("gmv_sum")).alias(gmv_name),
        X.as_long(F.countDistinct("order_id")).alias("orders"),
        X.rounded(X.ratio(F.sum("price_sum"), F.sum("price_cnt")), 2).alias("avg_item_price"),
    ).orderBy(*[F.col(name).asc_nulls_last() for name, _ in parts])


def weekday_pattern(star: Star, variant: str = "faithful") -> DataFrame:
    """Orders and GMV per day of week (0 = Sunday, names padded to 9).

    The faithful mean divides by items; ``variant='corrected'`` by distinct orders.
    """
    orders = F.countDistinct("order_id")
    return order_facts(star, cols=(TS,)).groupBy(
        X.dow0(TS).cast("bigint").alias("day_of_week_num"), X.day_name(TS).alias("day_name")).agg(
        X.as_long(orders).alias("total_orders"),
        X.money(F.sum("gmv_sum")).alias("total_gmv"),
        X.rounded(X.ratio(F.sum("gmv_sum"), orders if variant == "corrected" else F.sum("gmv_cnt")), 2)
        .alias("avg_order_value"),
    ).orderBy(F.col("day_of_week_num").asc_nulls_last())

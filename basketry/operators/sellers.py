"""Seller service levels, revenue ranking and underperformer flags.

Facts are aggregated per seller_id before the sellers dimension is joined,
so a seller holding a large share of items is collapsed by the map-side
partial aggregate rather than landing in one join task.  Seller-level
ranks over all sellers use the distributed ordering plan; the top-k
report columns (rank, decile, running sum) are exact within the top-k
because every row ahead of a top-k row in the total order is in the top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.plans import ordering as O
from basketry.plans.facts import by_member, lines_of_orders
from basketry.plans.sizing import fold, partitions_for, salted
from basketry.session import materialize
from basketry.sources.star import Star

TS = "order_purchase_timestamp"
DELIV = "order_delivered_customer_date"
EST = "order_estimated_delivery_date"

# Underperformer thresholds (percent) and labels.
HIGH_PRIORITY_BREACH = 30
CRITICAL_BREACH = 50


def _delivered_with_date(est_required: bool):
    cond = X.is_delivered() & F.col(DELIV).isNotNull()
    return cond & F.col(EST).isNotNull() if est_required else cond


def _percentiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float], sort_values: bool) -> tuple[list, DataFrame | None]:
    """Exact percentiles of ``value`` with frequencies ``n`` per ``keys``: aggregates, or a frame to join.

    Value counts per group suit columns of few values (delivery days); sorted
    values suit any (``ordering.grouped_percentiles``), at a shuffle more.
    """
    if not sort_values:
        return [X.round_exact(F.percentile(value, q, F.col("n")), 1).alias(name) for name, q in qs.items()], None
    found = O.grouped_percentiles(rows, keys, value, "n", qs)
    return [], found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[X.round_exact(name, 1).alias(name) for name in qs])


def seller_sla(star: Star, min_orders: int = 10, sort_values: bool = False) -> DataFrame:
    """Per-seller delivery times (item grain), breach rate and exact percentiles (see ``_percentiles`` for ``sort_values``)."""
    parts = partitions_for(star.order_items)
    rows = lines_of_orders(star, _delivered_with_date(True), "seller_id", {"n": F.count(F.lit(1))}, (TS, DELIV, EST), parts).select(
        "seller_id", "order_id", "n",
        X.day_diff(TS, DELIV).alias("actual"), X.day_diff(TS, EST).alias("estimated"),
        X.day_diff(EST, DELIV).alias("delay"), X.is_late(DELIV, EST).alias("late"))
    # items of an order and seller fold where the join left them, with their
    # number as frequency; a repeated order counts at the first of its rows
    times = ["actual", "estimated", "delay", "late"]
    folded = rows.groupBy("order_id", "seller_id", *times).agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("order_id", "seller_id").orderBy(*times)) == 1
    n = F.col("n")

    def mean(c):
        return X.rounded(X.ratio(F.sum(F.col(c) * n), F.sum(F.when(F.col(c).isNotNull(), n))), 1)

    aggregates, sorted_ = _percentiles(folded, ["seller_id"], "actual", {"median_delivery_days": 0.5, "p95_delivery_days": 0.95}, sort_values)
    # value maps are built once a seller and salt, not in every task that holds some order of the seller
    per_seller = salted(folded.withColumn("first", F.when(first, 1).otherwise(0)), parts, "seller_id").groupBy("seller_id").agg(
        F.sum("first").alias("total_orders"), mean("actual").alias("avg_actual_days"),
        mean("estimated").alias("avg_estimated_days"), mean("delay").alias("avg_delay_days"),
        F.sum(F.col("late") * n).alias("late_orders"),
        X.pct(F.sum(F.col("late") * n), F.sum(n), 2).alias("sla_breach_rate_pct"), *aggregates) \
        .filter(F.col("total_orders") >= min_orders)
    if sorted_ is not None:
        per_seller = per_seller.join(sorted_, F.col("seller_id") == F.col("_seller_id"), "left")
    return per_seller.join(star.sellers.select("seller_id", "seller_state", "seller_city"), "seller_id") \
        .select("seller_id", "seller_state", "seller_city", "total_orders", "avg_actual_days",
                "avg_estimated_days", "avg_delay_days", "late_orders", "sla_breach_rate_pct",
                "median_delivery_days", "p95_delivery_days") \
        .orderBy(F.col("sla_breach_rate_pct").desc_nulls_first(), "seller_id")


def seller_revenue(star: Star) -> DataFrame:
    """Per seller: revenue, freight, mean price, distinct orders, customers and products, in one pass over the items.

    (order, seller) lines carry the order's products and, where the order join
    leaves them, its customers; ``facts.by_member`` counts both kinds at once.
    """
    lines = lines_of_orders(star, X.is_valid(), "seller_id", {
        "price": F.sum("price"), "n_price": F.count("price"), "freight": F.sum("freight_value"), "products": F.collect_set("product_id")},
        ("customer_id",), partitions_for(star.order_items))
    per_order = lines.groupBy("order_id", "seller_id").agg(  # one row but for orders that repeat, or are spread by a salt
        *[F.sum(c).alias(c) for c in ("price", "n_price", "freight")], F.flatten(F.collect_set("products")).alias("products"),
        F.collect_set("customer_id").alias("customers"))
    per_seller = by_member(per_order, ["seller_id"], {"unique_customers": "customers", "unique_products": "products"}, ["price", "n_price", "freight"])
    return per_seller.select(
        "seller_id", F.round("price", 2).alias("_rev"), F.round("freight", 2).alias("_freight"),
        X.rounded(X.ratio(F.col("price"), F.col("n_price")), 2).alias("avg_item_price"),
        F.col("n_orders").alias("total_orders"), "unique_customers", "unique_products") \
        .join(star.sellers.select("seller_id", "seller_state"), "seller_id")


def seller_ranking(star: Star, limit: int = 100, per_bucket: int | None = None) -> DataFrame:
    """Top sellers by revenue: two ranks, decile, share of total, running revenue.

    All of them go along range buckets of the sellers' orders (``plans.ordering``):
    no window holds all sellers, whatever ``limit``.
    """
    sellers = materialize(seller_revenue(star))
    n, total = sellers.agg(F.count(F.lit(1)), F.sum("_rev")).first()
    along = [O.desc("_rev"), O.asc("seller_id")]
    ranked = O.with_rank(sellers, [O.desc("total_orders")], [O.asc("seller_id")], "orders_rank", n, per_bucket)
    ranked = O.with_rank(ranked, [O.desc("_rev")], [O.asc("seller_id")], "revenue_rank", n, per_bucket, sellers)
    ranked = O.with_position(ranked, along, n, "_pos", per_bucket, sellers)
    ranked = O.with_running_sum(ranked, along, "_rev", "_cumulative", n, per_bucket, sellers)
    return ranked.select(
        "seller_id", "seller_state",
        X.money("_rev").alias("total_revenue"), X.money("_freight").alias("total_freight"),
        "total_orders", "unique_products", "unique_customers", "avg_item_price", "revenue_rank", "orders_rank",
        O.ntile_of(F.col("_pos"), n, 10).alias("revenue_decile"),
        X.pct(F.col("_rev"), F.lit(total), 2).alias("revenue_share_pct"),
        F.col("_cumulative").cast("double").alias("cumulative_revenue"),
    ).orderBy("revenue_rank", "seller_id").limit(limit)


def underperformers(star: Star, min_items: int = 5) -> DataFrame:
    """Sellers flagged by revenue quartile and SLA breach rate: one lazy plan, the exact quartile a scalar of it."""
    # one pass over the items: (order, seller) lines with what revenue, service level and reviews each need
    valid, delivered = F.coalesce(X.is_valid(), F.lit(False)), F.coalesce(_delivered_with_date(False), F.lit(False))
    parts = partitions_for(star.order_items)
    lines = lines_of_orders(star, F.lit(True), "seller_id", {"n": F.count(F.lit(1)), "price": F.sum("price")}, ("order_status", DELIV, EST), parts)
    pairs = lines.groupBy("order_id", "seller_id").agg(
        F.sum("n").alias("n"), F.max(F.when(valid, 1).otherwise(0)).alias("valid"),
        F.sum(F.when(valid, F.col("price"))).alias("price"), F.sum(F.when(delivered, F.col("n")).otherwise(0)).alias("delivered"),
        F.sum(F.when(delivered, X.is_late(DELIV, EST) * F.col("n")).otherwise(0)).alias("late"))
    # Reviews joined at item x review grain, pre-aggregated per order.
    review_sums = fold(star.order_reviews, parts, "order_id", [], {"s_sum": F.sum("review_score"), "s_cnt": F.count("review_score")}) \
        .withColumn("reviewed", F.lit(1))
    per_seller = pairs.join(review_sums, "order_id", "left").groupBy("seller_id").agg(
        F.round(F.sum("price"), 2).alias("_rev"), F.sum("valid").alias("total_orders"),
        F.sum("delivered").alias("delivered_orders"), F.sum("late").alias("late"), F.sum(F.col("n") * F.col("s_sum")).alias("points"),
        F.sum(F.col("n") * F.col("s_cnt")).alias("votes"), F.count("reviewed").alias("_reviewed"))
    # The last condition always holds: it names what only the result needs, so that the result and its
    # quartile read one and the same exchange of seller facts instead of two prunings of it.
    joined = per_seller.filter((F.col("total_orders") > 0) & (F.col("delivered_orders") >= F.greatest(F.lit(min_items), F.lit(1)))
                               & (F.col("_reviewed") > 0) & (F.xxhash64("late", "points", "votes") >= F.lit(-2**63))) \
        .select("seller_id", "_rev", "total_orders", X.pct("late", "delivered_orders", 2).alias("sla_breach_pct"),
                X.rounded(X.ratio("points", "votes"), 2).alias("avg_review_score")) \
        .join(star.sellers.select("seller_id", "seller_state"), "seller_id")
    low = F.col("_rev") < O.exact_percentile(joined, "_rev", 0.25)
    breach = F.col("sla_breach_pct")
    flag = (F.when(low & (breach > HIGH_PRIORITY_BREACH), "High Priority Review")
            .when(breach > CRITICAL_BREACH, "SLA Critical")
            .when(low, "Low Revenue").otherwise("Standard"))
    return joined.select(
        "seller_id", "seller_state", X.money("_rev").alias("total_revenue"), "total_orders",
        "sla_breach_pct", "avg_review_score", flag.alias("performance_flag"),
    ).orderBy(F.col("sla_breach_pct").desc_nulls_first(), F.col("total_revenue").asc_nulls_last(),
              "seller_id")


def state_delivery(star: Star, sort_values: bool = False) -> DataFrame:
    """Order-grain delivery days and late share per customer state, slowest first.

    Orders are reduced to (customer, delivery days) counts before the
    customers join, so a customer with a huge share of orders collapses
    map-side; the median uses the counts as frequencies.  With order_id and
    customer_id as keys this equals the order-grain join.
    """
    rows = star.orders.filter(_delivered_with_date(False)).select(
        "order_id", "customer_id", X.day_diff(TS, DELIV).alias("days"), X.is_late(DELIV, EST).alias("late"))
    states = star.customers.select("customer_id", "customer_state")
    per_days = rows.groupBy("customer_id", "days").agg(
        F.count(F.lit(1)).alias("n"), F.sum("late").alias("n_late")).join(states, "customer_id")
    n, valid_n = F.col("n"), F.when(F.col("days").isNotNull(), F.col("n"))
    aggregates, sorted_ = _percentiles(per_days, ["customer_state"], "days", {"median_delivery_days": 0.5}, sort_values)
    per_state = per_days.groupBy("customer_state").agg(
        X.ratio(F.sum(F.col("days") * n), F.sum(valid_n)).alias("_avg"),
        X.pct(F.sum("n_late"), F.sum(n), 2).alias("late_delivery_pct"), *aggregates)
    if sorted_ is not None:
        per_state = per_state.join(sorted_, F.col("customer_state").eqNullSafe(F.col("_customer_state")), "left")
    orders = rows.groupBy("customer_id").agg(F.countDistinct("order_id").alias("n_orders")) \
        .join(states, "customer_id").groupBy("customer_id", "customer_state").agg(F.max("n_orders").alias("n_orders")) \
        .groupBy(F.col("customer_state").alias("_state")) \
        .agg(F.sum("n_orders").cast("bigint").alias("total_orders"))
    per_state = per_state.join(orders, per_state["customer_state"].eqNullSafe(orders["_state"])).drop("_state")
    return per_state.select(
        "customer_state", "total_orders", F.round("_avg", 1).alias("avg_delivery_days"),
        "median_delivery_days", "late_delivery_pct",
        F.rank().over(Window.orderBy(F.col("_avg").desc_nulls_first())).cast("bigint")
        .alias("slowest_state_rank"),
    ).orderBy(F.col("avg_delivery_days").desc_nulls_first(), "customer_state")


def sla_trend(star: Star) -> DataFrame:
    """Monthly delivered orders, late share, mean delay and last month's late share."""
    rows = star.orders.filter(_delivered_with_date(True))
    monthly = rows.groupBy(X.month_start(TS).alias("order_month")).agg(
        F.count(F.lit(1)).alias("total_delivered"),
        F.sum(X.is_late(DELIV, EST)).alias("late_count"),
        X.rounded(X.avg_of(X.day_diff(EST, DELIV)), 1).alias("avg_delay_days"))
    late_pct = X.pct("late_count", "total_delivered", 2)
    by_month = Window.orderBy(F.col("order_month").asc_nulls_last())
    return monthly.select(
        "order_month", "total_delivered", X.as_long("late_count").alias("late_count"),
        late_pct.alias("late_pct"), "avg_delay_days",
        F.lag(late_pct).over(by_month).alias("prev_month_late_pct"),
    ).orderBy(F.col("order_month").asc_nulls_last())

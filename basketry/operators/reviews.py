"""Review-score analysis: distribution, delay buckets, categories, sellers, price, trend.

Joins that multiply reviews by items are done on order-level partial
aggregates: reviews per order (or per order and score) and items per
order (or per order and seller) are reduced first, and the item x review
fan-out is applied as a product of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.plans.sizing import dealt, fold, partitions_for
from basketry.plans.skew import join_splitting_hot_keys
from basketry.sources.star import Star

TS = "order_purchase_timestamp"
DELIV = "order_delivered_customer_date"
EST = "order_estimated_delivery_date"
SCORE = "review_score"

# Delivery-delay bucket labels in report order.
DELAY_BUCKETS = ["On Time / Early", "Late 1-3 days", "Late 4-7 days", "Late 8-14 days",
                 "Late 15+ days"]
# Order-value bucket labels and upper bounds (R$), report order.
PRICE_BUCKETS = [("Under R$50", 50), ("R$50–149", 150), ("R$150–299", 300),
                 ("R$300–499", 500), ("R$500+", None)]


def _order_of(labels) -> F.Column:
    return F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i + 1))])


def _reviews_per_order(star: Star, *cols: str) -> DataFrame:
    """Review rows counted per (order_id, cols): the order join then carries
    one row per distinct combination instead of one per review."""
    return star.order_reviews.groupBy("order_id", *cols).agg(F.count(F.lit(1)).alias("n_rev"))


def score_distribution(star: Star) -> DataFrame:
    rows = _reviews_per_order(star, SCORE, "review_creation_date").join(
        star.orders.select("order_id", TS), "order_id") \
        .withColumn("_days", X.day_diff(TS, "review_creation_date"))
    n = F.col("n_rev")
    per_score = rows.groupBy(SCORE).agg(
        F.sum(n).alias("review_count"),
        X.rounded(X.ratio(F.sum(F.col("_days") * n), F.sum(F.when(F.col("_days").isNotNull(), n))), 1)
        .alias("avg_days_to_review"))
    return per_score.select(
        SCORE, "review_count",
        X.pct(F.col("review_count"), F.sum("review_count").over(Window.partitionBy()), 2)
        .alias("pct_of_reviews"),  # window over at most six score groups
        "avg_days_to_review",
    ).orderBy(F.col(SCORE).asc_nulls_last())


def delay_bucket(variant: str = "faithful") -> F.Column:
    """Faithful: a same-day late delivery (day difference 0) falls to the last
    bucket; ``corrected`` cascades on the day difference so it joins 1-3."""
    d = X.day_diff(EST, DELIV)
    on_time = F.col(DELIV) <= F.col(EST)
    if variant == "faithful":
        return (F.when(on_time, DELAY_BUCKETS[0]).when(d.between(1, 3), DELAY_BUCKETS[1])
                .when(d.between(4, 7), DELAY_BUCKETS[2]).when(d.between(8, 14), DELAY_BUCKETS[3])
                .otherwise(DELAY_BUCKETS[4]))
    return (F.when(on_time, DELAY_BUCKETS[0]).when(d <= 3, DELAY_BUCKETS[1])
            .when(d <= 7, DELAY_BUCKETS[2]).when(d <= 14, DELAY_BUCKETS[3])
            .otherwise(DELAY_BUCKETS[4]))


def delay_vs_score(star: Star, variant: str = "faithful") -> DataFrame:
    delivered = X.is_delivered() & F.col(DELIV).isNotNull() & F.col(EST).isNotNull()
    rows = star.orders.filter(delivered).select("order_id", delay_bucket(variant).alias("delay_bucket")) \
        .join(_reviews_per_order(star, SCORE), "order_id")
    r = F.col("n_rev")
    low = F.sum(F.when(F.col(SCORE) <= 2, r).otherwise(0))
    five = F.sum(F.when(F.col(SCORE) == 5, r).otherwise(0))
    n = F.sum(r)
    return rows.groupBy("delay_bucket").agg(
        n.alias("order_count"),
        X.rounded(X.ratio(F.sum(F.col(SCORE) * r), F.sum(F.when(F.col(SCORE).isNotNull(), r))), 3)
        .alias("avg_review_score"),
        low.alias("low_score_count"), X.pct(low, n, 2).alias("low_score_pct"),
        five.alias("five_star_count"), X.pct(five, n, 2).alias("five_star_pct"),
    ).orderBy(_order_of(DELAY_BUCKETS)[F.col("delay_bucket")])


def low_score_share(star: Star) -> DataFrame:
    rows = _reviews_per_order(star, SCORE).join(
        star.orders.filter(X.is_delivered()).select("order_id"), "order_id")
    r = F.col("n_rev")

    def count_where(cond):  # SUM(CASE WHEN cond THEN 1 ELSE 0 END) over review rows
        return F.sum(F.when(cond, r).otherwise(0))

    n = F.coalesce(F.sum(r), F.lit(0))
    below3, one = count_where(F.col(SCORE) < 3), count_where(F.col(SCORE) == 1)
    return rows.agg(
        n.alias("total_reviewed_orders"), below3.alias("below_3_star"),
        count_where(F.col(SCORE) <= 2).alias("one_or_two_star"), one.alias("one_star"),
        X.pct(below3, n, 2).alias("pct_below_3_stars"), X.pct(one, n, 2).alias("pct_one_star"))


def _category_score_counts(star: Star) -> DataFrame:
    """(category, score, review_count): item x review rows of delivered orders."""
    reviews = star.order_reviews.groupBy("order_id", SCORE).agg(F.count(F.lit(1)).alias("n_rev"))
    categories = star.products.select(
        "product_id", F.coalesce("product_category_name", F.lit("unknown")).alias("category"))
    items = join_splitting_hot_keys(star.order_items.select("order_id", "product_id"), categories,
                                    "product_id", hot=star.hot_keys("order_items", "product_id")) \
        .groupBy("order_id", "category").agg(F.count(F.lit(1)).alias("n_items"))
    rows = star.orders.filter(X.is_delivered()).select("order_id").join(items, "order_id") \
        .join(reviews, "order_id")
    return rows.groupBy("category", SCORE).agg(
        F.sum(F.col("n_items") * F.col("n_rev")).alias("review_count"))


def category_ratings(star: Star, min_reviews: int = 50, limit: int = 15,
                     variant: str = "faithful") -> DataFrame:
    """Lowest-rated categories.

    Faithful: the outer count is the number of score groups per category
    (at most six), so ``HAVING count >= 50`` keeps nothing, and the mean is
    over distinct scores.  ``corrected`` counts reviews and weights the mean.
    """
    cs = _category_score_counts(star)
    low = F.sum(F.when(F.col(SCORE) <= 2, F.col("review_count")).otherwise(0))
    if variant == "faithful":
        total, avg = F.count(F.lit(1)), X.avg_of(SCORE)
    else:
        total = F.sum("review_count")
        avg = X.ratio(F.sum(F.col(SCORE) * F.col("review_count")),
                      F.sum(F.when(F.col(SCORE).isNotNull(), F.col("review_count"))))
    per_cat = cs.groupBy("category").agg(
        X.as_long(total).alias("total_reviews"), avg.alias("_avg"),
        X.as_long(low).alias("low_reviews"),
        X.pct(low, F.sum("review_count"), 2).alias("low_score_rate_pct"),
    ).filter(F.col("total_reviews") >= min_reviews)
    # after HAVING: one row per category
    ranked = per_cat.withColumn(
        "worst_category_rank", F.rank().over(Window.orderBy(F.col("_avg").asc_nulls_last())).cast("bigint"))
    return ranked.orderBy(F.col("_avg").asc_nulls_last(), "category").limit(limit).select(
        "category", "total_reviews", F.round("_avg", 3).alias("avg_review_score"), "low_reviews",
        "low_score_rate_pct", "worst_category_rank")


def seller_ratings(star: Star, min_orders: int = 20, limit: int = 50) -> DataFrame:
    """Worst-rated sellers over item x review rows of delivered orders.

    The rank over the surviving sellers is evaluated inside the top-k,
    where it is exact (all rows ranked ahead of a top-k row are in it).
    """
    delivered = X.is_delivered() & F.col(DELIV).isNotNull()
    parts = partitions_for(star.order_items)
    per_order = fold(star.order_reviews, parts, "order_id", [], {
        "n_rev": F.count(F.lit(1)), "s_sum": F.sum(SCORE), "s_cnt": F.count(SCORE), "n_low": X.flag_sum(F.col(SCORE) <= 2)})
    orders = dealt(star.orders.filter(delivered).select("order_id", X.is_late(DELIV, EST).alias("late")), parts, "order_id")
    items = fold(star.order_items, parts, "order_id", ["seller_id"], {"n": F.count(F.lit(1))})
    rows = orders.join(per_order, "order_id").join(items, "order_id")
    n = F.col("n")
    rows_total = F.sum(n * F.col("n_rev"))
    per_seller = rows.groupBy("seller_id").agg(
        X.as_long(F.countDistinct("order_id")).alias("reviewed_orders"),
        X.ratio(F.sum(n * F.col("s_sum")), F.sum(n * F.col("s_cnt"))).alias("_avg"),
        X.as_long(F.sum(n * F.col("n_low"))).alias("low_score_orders"),
        X.pct(F.sum(n * F.col("n_low")), rows_total, 2).alias("low_score_pct"),
        X.pct(F.sum(n * F.col("n_rev") * F.col("late")), rows_total, 2).alias("late_delivery_pct"),
    ).filter(F.col("reviewed_orders") >= min_orders) \
        .join(star.sellers.select("seller_id", "seller_state"), "seller_id")
    top = per_seller.orderBy(F.col("_avg").asc_nulls_last(), "seller_id").limit(limit)
    return top.select(
        "seller_id", "seller_state", "reviewed_orders", F.round("_avg", 3).alias("avg_review_score"),
        "low_score_orders", "low_score_pct", "late_delivery_pct",
        F.rank().over(Window.orderBy(F.col("_avg").asc_nulls_last())).cast("bigint")
        .alias("worst_seller_rank"),
    ).orderBy(F.col("avg_review_score").asc_nulls_last(), "seller_id")


def price_bucket_vs_score(star: Star) -> DataFrame:
    """Order value (sum of item prices per order and score) bucketed against score."""
    prices = star.order_items.groupBy("order_id").agg(F.sum("price").alias("p_sum"))
    reviews = star.order_reviews.groupBy("order_id", SCORE).agg(F.count(F.lit(1)).alias("n_rev"))
    orders = star.orders.filter(X.is_delivered()).groupBy("order_id").agg(F.count(F.lit(1)).alias("n_ord"))
    per_order = orders.join(prices, "order_id").join(reviews, "order_id").withColumn(
        "order_value", F.col("p_sum") * F.col("n_rev") * F.col("n_ord"))
    v = F.col("order_value")
    bucket = None
    for label, bound in PRICE_BUCKETS:
        if bound is None:
            bucket = bucket.otherwise(label)
        else:
            bucket = F.when(v < bound, label) if bucket is None else bucket.when(v < bound, label)
    low = X.flag_sum(F.col(SCORE) <= 2)
    n = F.count(F.lit(1))
    labels = [lab for lab, _ in PRICE_BUCKETS]
    return per_order.groupBy(bucket.alias("price_bucket")).agg(
        n.alias("order_count"), X.rounded(X.avg_of(SCORE), 3).alias("avg_review_score"),
        X.pct(low, n, 2).alias("low_score_pct"),
    ).orderBy(_order_of(labels)[F.col("price_bucket")])


def review_trend(star: Star) -> DataFrame:
    """Monthly review volume and mean score with month-over-month change."""
    monthly = star.order_reviews.groupBy(X.month_start("review_creation_date").alias("review_month")).agg(
        F.count(F.lit(1)).alias("review_count"), X.avg_of(SCORE).alias("_avg"),
        X.flag_sum(F.col(SCORE) == 5).alias("five_star"), X.flag_sum(F.col(SCORE) == 1).alias("one_star"),
        X.pct(X.flag_sum(F.col(SCORE) <= 2), F.count(F.lit(1)), 2).alias("low_score_pct"))
    by_month = Window.orderBy(F.col("review_month").asc_nulls_last())  # one row per month
    return monthly.select(
        "review_month", "review_count", F.round("_avg", 3).alias("avg_score"), "five_star", "one_star",
        "low_score_pct", F.round(F.col("_avg") - F.lag("_avg").over(by_month), 3).alias("mom_score_change"),
    ).orderBy(F.col("review_month").asc_nulls_last())

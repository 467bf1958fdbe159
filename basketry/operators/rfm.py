"""RFM scoring and segmentation.

Customer-level NTILEs are computed with the distributed ordering plan
(basketry.plans.ordering): range buckets of the total order
(metric, customer key) instead of one global window partition.  The
per-customer metrics are checkpointed once because three independent
orderings read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.plans import ordering as O
from basketry.plans.facts import order_facts
from basketry.session import materialize
from basketry.sources.star import Star

TS = "order_purchase_timestamp"

# The five-score segment rules, first match wins.
# (segment, r condition, f condition, m condition); None = no condition.
RFM5_RULES = [
    ("Champions", ("==", 5), (">=", 4), (">=", 4)),
    ("Loyal Customers", (">=", 3), (">=", 4), None),
    ("Potential Loyalists", (">=", 4), ("in", (1, 2)), (">=", 2)),
    ("Recent Customers", ("==", 5), ("==", 1), None),
    ("Promising", ("==", 4), ("==", 1), None),
    ("Need Attention", ("==", 3), ("<=", 2), ("<=", 3)),
    ("About to Sleep", ("<=", 2), ("<=", 2), ("<=", 3)),
    ("At Risk", ("<=", 2), (">=", 3), (">=", 3)),
    ("Cannot Lose Them", ("==", 1), (">=", 4), (">=", 4)),
    ("Hibernating", ("<=", 2), ("<=", 2), ("<=", 2)),
    ("Lost", ("==", 1), ("==", 1), None),
]
RFM5_DEFAULT = "Others"
HIGH_VALUE_RULES = RFM5_RULES[:2]

# The four-score chart segment rules (recency and frequency only).
RFM4_RULES = [
    ("Champions", ("==", 4), (">=", 3), None),
    ("Loyal Customers", (">=", 3), (">=", 2), None),
    ("Potential Loyalists", (">=", 3), ("==", 1), None),
    ("At Risk", ("==", 2), None, None),
]
RFM4_DEFAULT = "Lost"


def _test(c: Column, cond) -> Column:
    op, v = cond
    if op == "==":
        return c == v
    if op == ">=":
        return c >= v
    if op == "<=":
        return c <= v
    if op == "in":
        return c.isin(*v)
    raise ValueError(op)


def segment_of(rules, default, r="r_score", f="f_score", m="m_score") -> Column:
    """CASE chain over the rules; first matching rule wins."""
    out = None
    for name, *conds in rules:
        tests = [_test(F.col(c), cond) for c, cond in zip((r, f, m), conds) if cond is not None]
        cond = tests[0]
        for t in tests[1:]:
            cond = cond & t
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default) if default is not None else out


def reference_date(star: Star) -> Column:
    """Day after the latest valid purchase: a scalar subquery of the plan it is used in."""
    return star.orders.filter(X.is_valid()).agg(F.date_add(F.to_date(F.max(TS)), 1).alias("reference_date")).scalar()


GEO = ["customer_state", "customer_city"]


def rfm_metrics(star: Star, with_geo: bool = True, customer_key: str = "customer_id") -> DataFrame:
    """Per customer: recency days, distinct orders, rounded GMV, first/last order date.

    Orders are folded per customer_id first.  A customers row that repeats
    multiplies the amount, as the item-grain join does.  A person key
    (``customer_unique_id``) adds up its customer_ids and shows the place of
    the smallest of them.
    """
    out = order_facts(star).groupBy("customer_id").agg(
        F.to_date(F.max(TS)).alias("last_order_date"),
        F.to_date(F.min(TS)).alias("first_order_date"),
        X.as_long(F.countDistinct("order_id")).alias("frequency"),
        F.round(F.sum("gmv_sum"), 2).alias("monetary"))
    person = customer_key != "customer_id"
    if with_geo or person:
        names = ["customer_id", *([customer_key] if person else []), *(GEO if with_geo else [])]
        # rows of one customer_id are together after the join: no further shuffle
        out = out.join(star.customers.select(*names), "customer_id").groupBy(*names).agg(
            F.max("last_order_date").alias("last_order_date"), F.min("first_order_date").alias("first_order_date"),
            F.max("frequency").alias("frequency"), F.sum("monetary").alias("monetary"))
    if person:
        place = [F.min(F.struct("customer_id", *GEO)).alias("_place")] if with_geo else []
        out = out.groupBy(customer_key).agg(
            F.max("last_order_date").alias("last_order_date"), F.min("first_order_date").alias("first_order_date"),
            F.sum("frequency").alias("frequency"), F.sum("monetary").alias("monetary"), *place)
        if with_geo:
            out = out.select("*", *[F.col(f"_place.{c}").alias(c) for c in GEO]).drop("_place")
    return out.withColumn("recency_days", X.as_long(F.datediff(reference_date(star), F.col("last_order_date"))))


def score(metrics: DataFrame, key: str, tiles: int, specs: dict, per_bucket: int | None = None) -> DataFrame:
    """Add NTILE scores; ``specs`` maps output column -> (sort Key, invert?)."""
    metrics = materialize(metrics)
    n = metrics.count()
    out = O.with_ntiles(metrics, {name: ([k, O.asc(key)], tiles) for name, (k, _) in specs.items()}, n, per_bucket)
    for name, (_, invert) in specs.items():
        if invert:
            out = out.withColumn(name, (tiles + 1 - F.col(name)).cast("bigint"))
    return out


def rfm_scores(star: Star, with_geo: bool = True, variant: str = "faithful",
               per_bucket: int | None = None, customer_key: str = "customer_id", tiles: int = 5) -> DataFrame:
    specs = {
        # faithful: tiles + 1 - NTILE over recency DESC gives the oldest customers the best score
        "r_score": (O.desc("recency_days"), variant == "faithful"),
        "f_score": (O.asc("frequency"), False),
        "m_score": (O.asc("monetary"), False),
    }
    if variant != "faithful":
        specs["r_score"] = (O.desc("recency_days"), False)
    return score(rfm_metrics(star, with_geo, customer_key), customer_key, tiles, specs, per_bucket)


def rfm_table(star: Star, variant: str = "faithful", per_bucket: int | None = None,
              customer_key: str = "customer_id", tiles: int = 5, rules=RFM5_RULES, default=RFM5_DEFAULT) -> DataFrame:
    """Scores 1..``tiles`` and the first matching rule's segment per customer."""
    s = rfm_scores(star, True, variant, per_bucket, customer_key, tiles)
    return s.select(
        customer_key, "customer_state", "customer_city", "recency_days", "frequency",
        X.money("monetary").alias("monetary_value"), "first_order_date", "last_order_date",
        "r_score", "f_score", "m_score",
        (F.col("r_score") + F.col("f_score") + F.col("m_score")).alias("rfm_total"),
        F.concat(F.col("r_score").cast("string"), F.col("f_score").cast("string"),
                 F.col("m_score").cast("string")).alias("rfm_cell"),
        segment_of(rules, default).alias("rfm_segment"),
    ).orderBy(F.col("rfm_total").desc(), customer_key)


def rfm_segment_summary(star: Star, variant: str = "faithful", per_bucket: int | None = None,
                        customer_key: str = "customer_id", tiles: int = 5, rules=RFM5_RULES,
                        default=RFM5_DEFAULT) -> DataFrame:
    """Segment sizes, averages and revenue shares (customers joined only for another key)."""
    s = rfm_scores(star, False, variant, per_bucket, customer_key, tiles).withColumn(
        "rfm_segment", segment_of(rules, default))
    seg = s.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        X.rounded(X.avg_of("recency_days"), 1).alias("avg_recency_days"),
        X.rounded(X.avg_of("frequency"), 2).alias("avg_frequency"),
        X.rounded(X.avg_of("monetary"), 2).alias("avg_monetary_value"),
        F.round(F.sum("monetary"), 2).alias("_rev"))
    w = Window.partitionBy()  # one row per segment: at most 12 rows
    return seg.select(
        "rfm_segment", "customer_count",
        X.pct(F.col("customer_count"), F.sum("customer_count").over(w), 2).alias("pct_of_customers"),
        "avg_recency_days", "avg_frequency", "avg_monetary_value",
        X.money("_rev").alias("total_revenue"),
        X.pct(F.col("_rev"), F.sum("_rev").over(w), 2).alias("pct_of_revenue"),
        "_rev",
    ).orderBy(F.col("_rev").desc_nulls_first(), "rfm_segment").drop("_rev")


def high_value_customers(star: Star, limit: int = 500, variant: str = "faithful",
                         per_bucket: int | None = None, customer_key: str = "customer_id",
                         tiles: int = 5, rules=HIGH_VALUE_RULES) -> DataFrame:
    """Customers of the ``rules``' segments by monetary value (top ``limit``)."""
    s = rfm_scores(star, True, variant, per_bucket, customer_key, tiles).withColumn(
        "rfm_segment", segment_of(rules, None))
    return s.filter(F.col("rfm_segment").isNotNull()).orderBy(
        F.col("monetary").desc_nulls_first(), customer_key).limit(limit).select(
        customer_key, "customer_state", "customer_city", "recency_days", "frequency",
        X.money("monetary").alias("monetary_value"), "r_score", "f_score", "m_score", "rfm_segment")


def rfm4_segment_sizes(star: Star, variant: str = "faithful", per_bucket: int | None = None) -> DataFrame:
    """Chart feed: quartile RFM on delivered orders keyed by the person id.

    Faithful: NTILE(4) over the last order date DESC, so the newest buyers
    get r = 1.  ``variant='corrected'`` orders it ascending.  The monetary
    quartile is not used by the rules and is therefore not computed.
    """
    key = "customer_unique_id"
    # reduced per customer before the customers join (hot customers collapse
    # map-side); order_id is a key, so per-customer distinct counts add up
    per_customer = order_facts(star, X.is_delivered()).groupBy("customer_id").agg(
        F.max(TS).alias("_last"), F.countDistinct("order_id").alias("_n"))
    metrics = per_customer.join(star.customers.select("customer_id", key), "customer_id").groupBy("customer_id", key).agg(
        F.max("_last").alias("_last"), F.max("_n").alias("_n")).groupBy(key).agg(
        F.to_date(F.max("_last")).alias("last_order"),
        X.as_long(F.sum("_n")).alias("frequency"))
    r_key = O.desc("last_order") if variant == "faithful" else O.asc("last_order")
    s = score(metrics, key, 4, {"r_score": (r_key, False), "f_score": (O.asc("frequency"), False)},
              per_bucket)
    return s.groupBy(segment_of(RFM4_RULES, RFM4_DEFAULT).alias("segment")).agg(
        F.count(F.lit(1)).alias("customer_count")).orderBy(F.col("customer_count").desc(), "segment")

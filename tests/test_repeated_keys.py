"""Orders and customers that repeat: operators equal plain item-grain joins."""

import pytest

from basketry.operators import quality, revenue, reviews, rfm, sellers
from basketry.registry import star_for
from scale import SF_SMALL

VALID = "o.order_status NOT IN ('canceled', 'unavailable')"
ITEMS = "order_items i JOIN orders o ON i.order_id = o.order_id"


@pytest.fixture(scope="module")
def star(spark):
    star = star_for(spark, SF_SMALL)
    twice = {"orders": "order_id % 5 = 0", "customers": "customer_id % 3 = 0"}
    star = star.replace(**{t: star.table(t).unionAll(star.table(t).filter(c)) for t, c in twice.items()})
    for name, df in star.items():
        df.createOrReplaceTempView(name)
    return star


def _same(spark, got, sql, columns):
    want = spark.sql(sql).collect()
    got = got.select(*columns).collect()
    assert len(want) == len(got) > 0

    def norm(rows):
        return sorted(tuple(round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v) for v in r)
                      for r in rows)
    assert norm(got) == norm(want)


def test_duplicate_orders_are_reported(spark, star):
    _same(spark, quality.duplicate_orders(star), "SELECT order_id, count(*) AS cnt FROM orders GROUP BY 1 HAVING count(*) > 1",
          ["order_id", "cnt"])


def test_trend(spark, star):
    _same(spark, revenue.period_trend(star, grain="quarter"), f"""
        SELECT date_trunc('quarter', o.order_purchase_timestamp), sum(price + freight_value), count(DISTINCT o.order_id),
               count(DISTINCT o.customer_id) FROM {ITEMS} WHERE {VALID} GROUP BY 1""",
          ["order_quarter", "gmv", "total_orders", "unique_customers"])


def test_state_revenue_and_delivery(spark, star):
    _same(spark, revenue.state_revenue(star), f"""
        SELECT c.customer_state, count(DISTINCT o.order_id), sum(price + freight_value), count(DISTINCT o.customer_id)
        FROM {ITEMS} JOIN customers c ON o.customer_id = c.customer_id WHERE {VALID} GROUP BY 1""",
          ["customer_state", "total_orders", "total_gmv", "unique_customers"])
    _same(spark, sellers.state_delivery(star), """
        SELECT c.customer_state, count(DISTINCT o.order_id) FROM orders o JOIN customers c ON o.customer_id = c.customer_id
        WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL GROUP BY 1""",
          ["customer_state", "total_orders"])


def test_categories(spark, star):
    _same(spark, revenue.category_ranking(star, limit=1000), f"""
        SELECT coalesce(p.product_category_name, 'unknown'), sum(price), count(DISTINCT o.order_id), count(DISTINCT i.product_id)
        FROM {ITEMS} JOIN products p ON i.product_id = p.product_id WHERE {VALID} GROUP BY 1""",
          ["category", "total_revenue", "total_orders", "unique_products"])


def test_rfm(spark, star):
    _same(spark, rfm.rfm_table(star), f"""
        SELECT c.customer_id, count(DISTINCT o.order_id), sum(price + freight_value)
        FROM {ITEMS} JOIN customers c ON o.customer_id = c.customer_id WHERE {VALID} GROUP BY 1""",
          ["customer_id", "frequency", "monetary_value"])


def test_person_rfm_with_three_tiles(spark, star):
    rules = [("best", ("==", 3), None, None)]
    got = rfm.rfm_table(star, customer_key="customer_unique_id", tiles=3, rules=rules, default="rest")
    rows = got.collect()
    assert {r.r_score for r in rows} == {1, 2, 3}
    assert all(r.rfm_segment == ("best" if r.r_score == 3 else "rest") for r in rows)
    assert len({r.customer_unique_id for r in rows}) == len(rows)


def test_sellers(spark, star):
    late = "CASE WHEN o.order_delivered_customer_date > o.order_estimated_delivery_date THEN 1 ELSE 0 END"
    dated = "o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL"
    _same(spark, sellers.seller_sla(star, min_orders=1), f"""
        SELECT i.seller_id, count(DISTINCT o.order_id), sum({late}),
               percentile(datediff(o.order_delivered_customer_date, o.order_purchase_timestamp), 0.5)
        FROM {ITEMS} JOIN sellers s ON i.seller_id = s.seller_id
        WHERE {dated} AND o.order_estimated_delivery_date IS NOT NULL GROUP BY 1""",
          ["seller_id", "total_orders", "late_orders", "median_delivery_days"])
    _same(spark, sellers.seller_ranking(star, limit=10**6), f"""
        SELECT i.seller_id, sum(price), count(DISTINCT o.order_id), count(DISTINCT i.product_id), count(DISTINCT o.customer_id)
        FROM {ITEMS} JOIN sellers s ON i.seller_id = s.seller_id WHERE {VALID} GROUP BY 1""",
          ["seller_id", "total_revenue", "total_orders", "unique_products", "unique_customers"])
    # one pass over items with conditional sums; an item counts once for each review of its order's rows
    _same(spark, sellers.underperformers(star, min_items=1), f"""
        SELECT i.seller_id, sum(CASE WHEN {VALID} THEN price END), count(DISTINCT CASE WHEN {VALID} THEN o.order_id END),
               round(sum(CASE WHEN {dated} THEN {late} ELSE 0 END) * 100.0 / sum(CASE WHEN {dated} THEN 1 ELSE 0 END), 2),
               round(sum(w.points) / sum(w.votes), 2)
        FROM {ITEMS} JOIN sellers s ON i.seller_id = s.seller_id
        LEFT JOIN (SELECT order_id, sum(review_score) AS points, count(review_score) AS votes FROM order_reviews GROUP BY 1) w
          ON w.order_id = o.order_id
        GROUP BY 1 HAVING count(DISTINCT CASE WHEN {VALID} THEN o.order_id END) > 0 AND sum(CASE WHEN {dated} THEN 1 ELSE 0 END) > 0
          AND count(w.votes) > 0""",
          ["seller_id", "total_revenue", "total_orders", "sla_breach_pct", "avg_review_score"])


def test_faithful_category_ratings_with_a_low_threshold(spark, star):
    _same(spark, reviews.category_ratings(star, min_reviews=1, limit=1000), f"""
        WITH g AS (SELECT coalesce(p.product_category_name, 'unknown') AS category, w.review_score AS s, count(*) AS n
                   FROM {ITEMS} JOIN products p ON i.product_id = p.product_id JOIN order_reviews w ON w.order_id = o.order_id
                   WHERE o.order_status = 'delivered' GROUP BY 1, 2)
        SELECT category, count(*), sum(CASE WHEN s <= 2 THEN n ELSE 0 END) FROM g GROUP BY 1""",
          ["category", "total_reviews", "low_reviews"])

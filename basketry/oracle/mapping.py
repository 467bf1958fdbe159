"""The test-table -> star mapping as DuckDB CTEs (ec_* relations).

Mirrors basketry.sources.testdata; prefixed to every oracle query.
"""

_SCORE = ("CASE WHEN o_orderkey % 333 = 5 THEN NULL "
          "WHEN o_orderkey % 100 < 78 THEN (CASE WHEN o_orderkey % 7 < 4 THEN 5 "
          "WHEN o_orderkey % 7 = 4 THEN 4 WHEN o_orderkey % 7 = 5 THEN 3 ELSE 2 END) "
          "ELSE 1 + o_orderkey % 4 END")


def _cents(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2))"


MAPPING_CTES = f"""
ec_customers AS (
  SELECT c.c_custkey AS customer_id,
         c.c_custkey - c.c_custkey % 2 AS customer_unique_id,
         1000 + c.c_custkey % 500 AS customer_zip_code_prefix,
         CONCAT(n.n_name, '_C', CAST(c.c_custkey % 7 AS VARCHAR)) AS customer_city,
         n.n_name AS customer_state
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
ec_sellers AS (
  SELECT s.s_suppkey AS seller_id,
         CONCAT(n.n_name, '_S', CAST(s.s_suppkey % 5 AS VARCHAR)) AS seller_city,
         n.n_name AS seller_state
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
),
ec_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN ''
              ELSE p_brand END AS product_category_name
  FROM part
),
ec_orders_base AS (
  SELECT o_orderkey AS k, o_custkey, o_orderdate,
         CASE o_orderkey % 40 WHEN 7 THEN 'canceled' WHEN 8 THEN 'unavailable'
              WHEN 9 THEN 'shipped' WHEN 10 THEN 'invoiced' ELSE 'delivered' END AS st,
         o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24) AS purchase,
         o_orderdate + INTERVAL '1' DAY * (12 + o_orderkey % 20) AS est,
         CASE WHEN o_orderkey % 100 < 78 THEN -(1 + o_orderkey % 9)
              WHEN o_orderkey % 100 < 82 THEN 0
              WHEN o_orderkey % 100 < 86 THEN 1 + o_orderkey % 3
              WHEN o_orderkey % 100 < 90 THEN 4 + o_orderkey % 4
              WHEN o_orderkey % 100 < 95 THEN 8 + o_orderkey % 7
              ELSE 15 + o_orderkey % 20 END AS delay
  FROM orders
),
ec_orders AS (
  SELECT k AS order_id, o_custkey AS customer_id, st AS order_status,
         purchase AS order_purchase_timestamp,
         CASE WHEN st IN ('canceled', 'unavailable') THEN NULL
              ELSE purchase + INTERVAL '1' DAY * (1 + k % 4) END AS order_delivered_carrier_date,
         CASE WHEN st = 'delivered' AND k % 33 <> 0
              THEN est + INTERVAL '1' DAY * delay + INTERVAL '1' HOUR * (k % 23 + 1)
         END AS order_delivered_customer_date,
         CASE WHEN k % 211 = 5 THEN NULL ELSE est END AS order_estimated_delivery_date
  FROM ec_orders_base
),
ec_order_items AS (
  SELECT CASE WHEN l_orderkey % 1009 = 4 THEN -1 ELSE l_orderkey END AS order_id,
         CAST(l_linenumber AS INTEGER) AS order_item_id,
         CASE WHEN l_orderkey % 997 = 2 THEN -1 ELSE l_partkey END AS product_id,
         CASE WHEN l_orderkey % 1013 = 6 THEN -1
              WHEN l_suppkey % 10 IN (3, 4) AND l_orderkey % 100 < 78 AND l_partkey % 4 <> 0 THEN l_suppkey + 2
              WHEN l_suppkey = 7 AND l_orderkey % 25 <> 0 OR l_suppkey = 8 AND l_orderkey % 100 <> 0 THEN 9
              ELSE l_suppkey END AS seller_id,
         {_cents('''CASE WHEN l_orderkey % 500 = 1 THEN 0
              WHEN l_suppkey % 10 = 4 THEN 5 * CAST(FLOOR(l_extendedprice / 10) AS BIGINT)
              WHEN l_suppkey % 10 = 5 THEN CAST(FLOOR(l_extendedprice / 50) AS BIGINT)
              ELSE CAST(FLOOR(l_extendedprice / 10) AS BIGINT) END''')} AS price,
         {_cents('CAST(FLOOR(l_extendedprice / 100) AS BIGINT) + l_linenumber')} AS freight_value
  FROM lineitem
),
ec_order_payments AS (
  SELECT CASE WHEN o_orderkey % 150 = 0 THEN -1 ELSE o_orderkey END AS order_id, 1 AS payment_sequential,
         CASE WHEN o_orderkey % 10 < 7 THEN 'credit_card' WHEN o_orderkey % 10 < 9 THEN 'boleto'
              ELSE 'debit_card' END AS payment_type,
         CAST(CASE WHEN o_orderkey % 10 < 7 THEN 1 + o_orderkey % 12 ELSE 1 END AS INTEGER)
           AS payment_installments,
         {_cents('CAST(FLOOR(o_totalprice / 10) AS BIGINT)')} AS payment_value
  FROM orders
  UNION ALL
  SELECT o_orderkey, 2, 'voucher', CAST(1 AS INTEGER), {_cents('100 + o_orderkey % 900')}
  FROM orders WHERE o_orderkey % 20 = 3
),
ec_order_reviews AS (
  SELECT CASE WHEN o_orderkey % 50 = 11 THEN -1 ELSE o_orderkey END AS order_id, CAST({_SCORE} AS INTEGER) AS review_score,
         o_orderdate + INTERVAL '1' DAY * (14 + o_orderkey % 25) AS review_creation_date
  FROM orders
  UNION ALL
  SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN {_SCORE} ELSE 1 END AS INTEGER),
         o_orderdate + INTERVAL '1' DAY * (14 + o_orderkey % 25)
  FROM orders WHERE o_orderkey % 100 = 12
),
ec_geolocation AS (
  SELECT 1000 + c.c_custkey % 500 AS geolocation_zip_code_prefix,
         CAST(c.c_custkey % 180 - 90 AS DOUBLE) AS geolocation_lat,
         CAST(c.c_custkey % 360 - 180 AS DOUBLE) AS geolocation_lng,
         CONCAT(n.n_name, '_C', CAST(c.c_custkey % 7 AS VARCHAR)) AS geolocation_city,
         n.n_name AS geolocation_state
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def with_star(body: str) -> str:
    """Prefix a query over the ec_* relations with the mapping CTEs.

    ``body`` may start with its own ``WITH`` clause; its CTEs are appended.
    """
    text = body.strip()
    if text[:4].upper() == "WITH":
        return f"WITH {MAPPING_CTES},\n{text[4:].lstrip()}"
    return f"WITH {MAPPING_CTES}\n{text}"

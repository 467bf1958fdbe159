"""Explicit schemas of the eight star tables (never inferred)."""

from pyspark.sql.types import (DecimalType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType,
                               TimestampNTZType)

MONEY = DecimalType(12, 2)


def _s(*fields):
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


ORDERS = _s(("order_id", LongType()), ("customer_id", LongType()),
            ("order_status", StringType()),
            ("order_purchase_timestamp", TimestampNTZType()),
            ("order_approved_at", TimestampNTZType()),
            ("order_delivered_carrier_date", TimestampNTZType()),
            ("order_delivered_customer_date", TimestampNTZType()),
            ("order_estimated_delivery_date", TimestampNTZType()))

ORDER_ITEMS = _s(("order_id", LongType()), ("order_item_id", IntegerType()),
                 ("product_id", LongType()), ("seller_id", LongType()),
                 ("price", MONEY), ("freight_value", MONEY))

CUSTOMERS = _s(("customer_id", LongType()), ("customer_unique_id", LongType()),
               ("customer_zip_code_prefix", LongType()),
               ("customer_city", StringType()), ("customer_state", StringType()))

SELLERS = _s(("seller_id", LongType()), ("seller_city", StringType()),
             ("seller_state", StringType()))

PRODUCTS = _s(("product_id", LongType()), ("product_category_name", StringType()))

ORDER_PAYMENTS = _s(("order_id", LongType()), ("payment_sequential", IntegerType()),
                    ("payment_type", StringType()),
                    ("payment_installments", IntegerType()),
                    ("payment_value", MONEY))

ORDER_REVIEWS = _s(("order_id", LongType()), ("review_score", IntegerType()),
                   ("review_creation_date", TimestampNTZType()))

GEOLOCATION = _s(("geolocation_zip_code_prefix", LongType()),
                 ("geolocation_lat", DoubleType()), ("geolocation_lng", DoubleType()),
                 ("geolocation_city", StringType()), ("geolocation_state", StringType()))

SCHEMAS = {
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "customers": CUSTOMERS,
    "sellers": SELLERS,
    "products": PRODUCTS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "geolocation": GEOLOCATION,
}

# Primary keys; reviews and geolocation have none.
KEYS = {
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "customers": ("customer_id",),
    "sellers": ("seller_id",),
    "products": ("product_id",),
    "order_payments": ("order_id", "payment_sequential"),
}

"""Derive the commerce star from the driver's TPC-H-like test tables.

Only integer arithmetic on keys is used, so the same rows can be produced
by any SQL engine (see basketry.oracle.mapping for the SQL form).  Every
table is a narrow projection/filter of one raw table, except the two
dimension joins with ``nation`` (25 rows by definition of the raw schema,
so that one broadcast is bounded).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.star import Star



def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _cents(c: Column) -> Column:
    """Integer cents -> exact decimal(12,2)."""
    return (c.cast("decimal(12,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(12,2)")


def _floor_div(c: str, d: int) -> Column:
    return F.floor(F.col(c) / d).cast("bigint")


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n)


def _hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n)


def map_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    status = (F.when(k % 40 == 7, "canceled").when(k % 40 == 8, "unavailable")
              .when(k % 40 == 9, "shipped").when(k % 40 == 10, "invoiced")
              .otherwise("delivered"))
    delay = (F.when(k % 100 < 78, -(1 + k % 9)).when(k % 100 < 82, F.lit(0))
             .when(k % 100 < 86, 1 + k % 3).when(k % 100 < 90, 4 + k % 4)
             .when(k % 100 < 95, 8 + k % 7).otherwise(15 + k % 20))
    purchase = F.col("o_orderdate") + _hours(k % 24)
    est = F.col("o_orderdate") + _days(12 + k % 20)
    delivered = est + _days(delay) + _hours(k % 23 + 1)
    return orders.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        F.when(status != "invoiced", purchase + _hours(k % 5)).alias("order_approved_at"),
        F.when(~status.isin("canceled", "unavailable"), purchase + _days(1 + k % 4))
        .alias("order_delivered_carrier_date"),
        F.when((status == "delivered") & (k % 33 != 0), delivered)
        .alias("order_delivered_customer_date"),
        F.when(k % 211 != 5, est).alias("order_estimated_delivery_date"),
    )


def map_order_items(lineitem: DataFrame) -> DataFrame:
    k, supp, part = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey")
    # Re-assigned, not dropped: rows of would-be poor sellers go to seller l_suppkey + 2,
    # those of low-volume sellers to seller 9, so every lineitem row stays.
    poor = (supp % 10).isin(3, 4) & (k % 100 < 78) & (part % 4 != 0)
    rare = ((supp == 7) & (k % 25 != 0)) | ((supp == 8) & (k % 100 != 0))
    seller = F.when(k % 1013 == 6, F.lit(-1).cast("bigint")).when(poor, supp + 2).when(rare, F.lit(9).cast("bigint")).otherwise(supp)
    price_cents = (F.when(k % 500 == 1, F.lit(0).cast("bigint"))
                   .when(supp % 10 == 4, 5 * _floor_div("l_extendedprice", 10))
                   .when(supp % 10 == 5, _floor_div("l_extendedprice", 50))
                   .otherwise(_floor_div("l_extendedprice", 10)))
    return lineitem.select(
        F.when(k % 1009 == 4, F.lit(-1).cast("bigint")).otherwise(k).alias("order_id"),
        F.col("l_linenumber").cast("int").alias("order_item_id"),
        F.when(k % 997 == 2, F.lit(-1).cast("bigint")).otherwise(part).alias("product_id"),
        seller.alias("seller_id"),
        _cents(price_cents).alias("price"),
        _cents(_floor_div("l_extendedprice", 100) + F.col("l_linenumber")).alias("freight_value"),
    )


def map_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    return customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select(
        c.alias("customer_id"),
        (c - c % 2).alias("customer_unique_id"),
        (1000 + c % 500).alias("customer_zip_code_prefix"),
        F.concat(F.col("n_name"), F.lit("_C"), (c % 7).cast("string")).alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def map_sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).select(
        s.alias("seller_id"),
        F.concat(F.col("n_name"), F.lit("_S"), (s % 5).cast("string")).alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def map_products(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    category = (F.when(p % 37 == 0, F.lit(None).cast("string"))
                .when(p % 41 == 0, F.lit("")).otherwise(F.col("p_brand")))
    return part.select(p.alias("product_id"), category.alias("product_category_name"))


def map_order_payments(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    ptype = (F.when(k % 10 < 7, "credit_card").when(k % 10 < 9, "boleto")
             .otherwise("debit_card"))
    # an orphan key instead of a dropped row: 1 order in 150 has no payment
    first = orders.select(
        F.when(k % 150 == 0, F.lit(-1).cast("bigint")).otherwise(k).alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        ptype.alias("payment_type"),
        F.when(k % 10 < 7, 1 + k % 12).otherwise(1).cast("int").alias("payment_installments"),
        _cents(_floor_div("o_totalprice", 10)).alias("payment_value"),
    )
    voucher = orders.filter(k % 20 == 3).select(
        k.alias("order_id"),
        F.lit(2).alias("payment_sequential"),
        F.lit("voucher").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        _cents(100 + k % 900).alias("payment_value"),
    )
    return first.unionByName(voucher)


def _score(k: Column) -> Column:
    return (F.when(k % 333 == 5, F.lit(None).cast("int"))
            .when(k % 100 < 78,
                  F.when(k % 7 < 4, 5).when(k % 7 == 4, 4).when(k % 7 == 5, 3).otherwise(2))
            .otherwise(1 + k % 4)).cast("int")


def map_order_reviews(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    created = F.col("o_orderdate") + _days(14 + k % 25)
    # likewise 1 order in 50 has no review
    first = orders.select(
        F.when(k % 50 == 11, F.lit(-1).cast("bigint")).otherwise(k).alias("order_id"), _score(k).alias("review_score"),
        created.alias("review_creation_date"))
    second = orders.filter(k % 100 == 12).select(
        k.alias("order_id"),
        F.when(k % 3 == 0, _score(k)).otherwise(1).cast("int").alias("review_score"),
        created.alias("review_creation_date"))
    return first.unionByName(second)


def map_geolocation(customer: DataFrame, nation: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    return customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select(
        (1000 + c % 500).alias("geolocation_zip_code_prefix"),
        (c % 180 - 90).cast("double").alias("geolocation_lat"),
        (c % 360 - 180).cast("double").alias("geolocation_lng"),
        F.concat(F.col("n_name"), F.lit("_C"), (c % 7).cast("string")).alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )


def star_from_testdata(spark: SparkSession, sf_dir: str) -> Star:
    """The mapped star; each table's plan is built on first use."""
    raw: dict[str, DataFrame] = {}

    def r(name: str) -> DataFrame:
        if name not in raw:
            raw[name] = read_raw(spark, sf_dir, name)
            if name == "nation":
                raw[name] = raw[name].select("n_nationkey", "n_name")
        return raw[name]

    return Star(
        orders=lambda: map_orders(r("orders")),
        order_items=lambda: map_order_items(r("lineitem")),
        customers=lambda: map_customers(r("customer"), r("nation")),
        sellers=lambda: map_sellers(r("supplier"), r("nation")),
        products=lambda: map_products(r("part")),
        order_payments=lambda: map_order_payments(r("orders")),
        order_reviews=lambda: map_order_reviews(r("orders")),
        geolocation=lambda: map_geolocation(r("customer"), r("nation")),
    )

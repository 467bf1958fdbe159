"""Star readers/writers: explicit schemas, CSV blank handling, mapping counts."""

import tempfile

import pytest

from pyspark.sql import functions as F

from basketry.operators import quality, reviews
from basketry.registry import star_for
from basketry.sources import read_star, write_star
from basketry.sources.files import read_table
from basketry.sources.schema import SCHEMAS
from scale import SF_MID, SF_SMALL

# Row counts of the mapped star at sf0.01 (FIXTURES.md section 2.1).
EXPECTED_SF001 = {"orders": 15000, "order_items": 60000, "customers": 1500, "sellers": 100,
                  "products": 2000, "order_payments": 15750, "order_reviews": 15150,
                  "geolocation": 1500}


def test_mapping_counts(spark):
    star = star_for(spark, SF_MID)
    assert {name: df.count() for name, df in star.items()} == EXPECTED_SF001


def test_mapping_schemas_match_declared(spark):
    star = star_for(spark, SF_SMALL)
    for name, df in star.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in SCHEMAS[name]], name


def test_parquet_and_csv_round_trip(spark):
    star = star_for(spark, SF_SMALL)
    for fmt in ("parquet", "csv"):
        root = tempfile.mkdtemp(prefix=f"basketry-{fmt}-")
        write_star(star, root, fmt=fmt)
        back = read_star(spark, root, fmt=fmt)
        for name, df in star.items():
            assert back.table(name).count() == df.count(), (fmt, name)
            assert back.table(name).exceptAll(df).count() == 0, (fmt, name)


def test_csv_blank_category_policy(spark):
    star = star_for(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="basketry-csv-")
    write_star(star, root, fmt="csv")
    keep = read_star(spark, root, fmt="csv", blank_category="keep").products
    null = read_star(spark, root, fmt="csv", blank_category="null").products
    blanks = star.products.filter(F.col("product_category_name") == "").count()
    nulls = star.products.filter(F.col("product_category_name").isNull()).count()
    assert blanks > 0
    assert keep.filter(F.col("product_category_name") == "").count() == blanks
    assert null.filter(F.col("product_category_name").isNull()).count() == nulls + blanks


def test_cli_runs_operator_over_written_star(spark):
    import os
    from basketry.__main__ import main
    root = tempfile.mkdtemp(prefix="basketry-cli-")
    star = star_for(spark, SF_SMALL)
    write_star(star, os.path.join(root, "star"), fmt="csv")
    assert main(["rv06_weekday", "--star", os.path.join(root, "star"), "--format", "csv",
                 "--out", os.path.join(root, "out")]) == 0
    got = spark.read.parquet(os.path.join(root, "out"))
    from basketry.operators.revenue import weekday_pattern
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, weekday_pattern(star).collect()))


HEX = "e481f51cbdc54678b7cc49136f2d6af7"
PUBLISHED_ORDERS = f"""order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
{HEX},9ef432eb6251297304e76186b10a928d,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,2017-10-04 19:55:00,2017-10-10 21:25:13,2017-10-18 00:00:00
53cdb2fc8bc7dce0b6741e2150273451,b0830fb4747a6c6d20dea0b8c802d7ef,shipped,2018-07-24 20:41:37,,,,2018-08-13 00:00:00
"""


def test_csv_columns_are_taken_by_header_name(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(PUBLISHED_ORDERS)
    first, second = read_table(spark, f"file://{tmp_path}", "orders", "csv", ids="string").orderBy("order_status").collect()
    assert first.order_id == HEX
    assert str(first.order_delivered_carrier_date) == "2017-10-04 19:55:00"
    assert str(first.order_delivered_customer_date) == "2017-10-10 21:25:13"
    assert str(first.order_estimated_delivery_date) == "2017-10-18 00:00:00"
    assert second.order_delivered_carrier_date is None
    with pytest.raises(Exception):  # text ids are no longs: an error, not NULL
        read_table(spark, str(tmp_path), "orders", "csv").collect()


def test_uri_root_round_trip(spark, tmp_path):
    star = star_for(spark, SF_SMALL)
    root = f"file://{tmp_path}/star"
    write_star(star, root)
    assert read_star(spark, root).orders.count() == star.orders.count()


def test_orders_and_reviews_that_repeat_match_plain_joins(spark):
    """RS06 over doubled orders equals grouping the joined rows by order and score."""
    star = star_for(spark, SF_SMALL)
    some = star.orders.filter("order_id <= 200")
    doubled = star.replace(orders=star.orders.unionByName(some))
    got = {r.price_bucket: r.order_count for r in reviews.price_bucket_vs_score(doubled).collect()}
    joined = (doubled.orders.filter("order_status = 'delivered'").select("order_id").join(star.order_items, "order_id")
              .join(star.order_reviews, "order_id").groupBy("order_id", "review_score").agg(F.sum("price").alias("v")))
    bucket = F.expr("CASE WHEN v < 50 THEN 0 WHEN v < 150 THEN 1 WHEN v < 300 THEN 2 WHEN v < 500 THEN 3 ELSE 4 END")
    want = joined.groupBy(bucket.alias("b")).count().collect()
    assert sorted(got.values()) == sorted(r["count"] for r in want)


def test_orphans_with_many_null_keys_and_duplicates(spark):
    child = spark.createDataFrame([(None,)] * 50 + [(1,)] * 40 + [(2,)] * 5, "k long")
    parent = spark.createDataFrame([(1,), (1,)], "k long")
    assert quality.orphan_count(child, parent, "k", "n").collect()[0].n == 55
    assert quality.orphan_count(child.limit(0), parent, "k", "n").collect()[0].n == 0
    assert [tuple(r) for r in quality.duplicate_keys(child.filter("k = 2"), "k").collect()] == [(2, 5)]

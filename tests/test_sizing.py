"""Exchanges dealt by the size of the input: same rows, and as many partitions as the input asks for."""

import re

import pytest
from pyspark.sql import functions as F

from basketry.operators import revenue, reviews, sellers
from basketry.plans.facts import by_bitmap, by_folded
from basketry.plans.sizing import CONF_BYTES_PER_PARTITION, fold, partitions_for
from basketry.registry import star_for
from scale import SF_SMALL

OPERATORS = {
    "rv02": lambda s: revenue.category_ranking(s, limit=1000), "rv03": revenue.payment_mix,
    "rv03_corrected": lambda s: revenue.payment_mix(s, "corrected"), "sl01": lambda s: sellers.seller_sla(s, min_orders=1),
    "sl02": lambda s: sellers.seller_ranking(s, limit=1000), "sl03": lambda s: sellers.underperformers(s, min_items=1),
    "rs05": lambda s: reviews.seller_ratings(s, min_orders=1, limit=1000)}


@pytest.fixture
def small_partitions(spark):
    """Calls a function as if the items were many times the size a partition should have."""
    def call(make):
        spark.conf.set(CONF_BYTES_PER_PARTITION, "4000")
        try:
            return make()
        finally:
            spark.conf.unset(CONF_BYTES_PER_PARTITION)
    return call


@pytest.fixture(scope="module")
def odd_star(spark):
    """Orders that repeat, an order with a third of the items, keys that are NULL."""
    star = star_for(spark, SF_SMALL)
    hot = star.orders.agg(F.min("order_id")).first()[0]
    items = star.order_items.withColumn("order_id", F.when(F.col("product_id") % 3 == 0, hot).when(F.col("product_id") % 17 != 0, F.col("order_id"))) \
        .withColumn("seller_id", F.when(F.col("product_id") % 13 != 0, F.col("seller_id")))
    null_keys = {t: F.when(F.col("order_id") % 11 != 0, F.col("order_id")) for t in ("order_payments", "order_reviews")}
    return star.replace(order_items=items.unionAll(items.filter("product_id % 7 = 0")),
                        orders=star.orders.unionAll(star.orders.filter("order_id % 5 = 0")),
                        **{t: star.table(t).withColumn("order_id", c).unionAll(star.table(t).filter("order_id % 6 = 0")) for t, c in null_keys.items()})


@pytest.mark.parametrize("name", OPERATORS)
def test_dealt_rows_are_the_same(odd_star, small_partitions, name):
    plain, by_size = OPERATORS[name](odd_star), small_partitions(lambda: OPERATORS[name](odd_star))
    assert by_size.dtypes == plain.dtypes
    want = plain.collect()
    assert len(want) > 5 and sorted(map(str, by_size.collect())) == sorted(map(str, want))


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "sl02"])  # sl02 reads a checkpoint
def test_partitions_follow_the_items(spark, small_partitions, name):
    star = star_for(spark, SF_SMALL)
    n = small_partitions(lambda: partitions_for(star.order_items))
    assert n > 8 and partitions_for(star.order_items) is None
    plan = small_partitions(lambda: OPERATORS[name](star)._jdf.queryExecution().executedPlan().toString()).split("== Initial Plan ==")[0]
    dealt = {int(m) for m in re.findall(r"hashpartitioning\(order_id#\d+L, (\d+)\)", plan)}
    assert dealt == {n}  # no exchange by order goes to the session's fixed number


def test_fold_spreads_a_key_and_adds_it_up(spark):
    df = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 4 < 3, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    df = df.unionAll(df.limit(5).withColumn("k", F.lit(None).cast("long")))
    sums = {"s": F.sum("v"), "n": F.count("v")}
    want = sorted(map(str, fold(df, None, "k", ["g"], sums).filter("k is not null").collect()))
    assert sorted(map(str, fold(df, 6, "k", ["g"], sums).collect())) == want
    parts = fold(df, 6, "k", ["g"], sums, merge=False).filter("k = 7")
    assert 3 < parts.count() <= 3 * 16 and parts.agg(F.sum("n")).first()[0] == 3001


def test_folded_members_are_what_bitmaps_count(spark):
    rows = [(o, o % 3, (o * 7919) % 90_000 if o % 5 else None, o) for o in range(400)] + [(o, 1, 5, 2) for o in range(50)]
    df = spark.createDataFrame(rows, "o long, k long, m long, s long")
    want = sorted(map(str, by_bitmap(df, ["k"], "o", "m", ["s"], "ms").collect()))
    for n in (None, 7):
        assert sorted(map(str, by_folded(df, ["k"], "o", "m", ["s"], "ms", n).collect())) == want

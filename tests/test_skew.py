"""Hot-key split joins equal plain joins; hot keys really take the broadcast path."""

import pytest
from pyspark.sql import functions as F

from basketry.plans.skew import hot_keys, join_splitting_hot_keys
from basketry.registry import star_for
from scale import SF_SMALL


def test_hot_keys_bounded(spark):
    items = star_for(spark, SF_SMALL).order_items
    total = items.count()
    hot = hot_keys(items, "product_id", share=20 / total)
    assert 0 < len(hot) <= total / 20
    counts = dict(items.groupBy("product_id").count().collect())
    assert all(counts[k] > 20 for k in hot)


@pytest.mark.parametrize("share", [0.0002, 0.005, 1.0])
def test_split_join_equals_plain_join(spark, share):
    star = star_for(spark, SF_SMALL)
    items = star.order_items.select("order_id", "product_id", "price")
    cats = star.products.select("product_id", F.coalesce("product_category_name", F.lit("unknown")).alias("c"))
    got = join_splitting_hot_keys(items, cats, "product_id", share=share)
    want = items.join(cats, "product_id")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    if share < 0.001:
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_operators_with_hot_keys_forced_match_oracle(spark):
    """Force every key with more than 3 of 10,000 rows to be hot and re-check operators that use the split join."""
    from test_oracle import _compare, duck
    from basketry.plans.skew import CONF_HOT_KEY_SHARE
    con = duck(SF_SMALL)
    spark.conf.set(CONF_HOT_KEY_SHARE, "0.0003")
    try:
        for name in ("rv02_top_categories", "rv03_payment_mix", "rs04_category_ratings_corrected",
                     "dq09_items_missing_order", "dq10_items_missing_product", "dq11_items_missing_seller",
                     "sl01_seller_sla", "sl02_seller_ranking"):
            _compare(spark, con, SF_SMALL, name)
    finally:
        spark.conf.unset(CONF_HOT_KEY_SHARE)


def test_sampled_detection_finds_a_dominant_key(spark):
    # one key with 60% of 200k rows must be found from the sample
    df = spark.range(0, 200_000).select(F.when(F.col("id") % 5 < 3, F.lit(7)).otherwise(F.col("id")).alias("k"))
    assert hot_keys(df, "k", share=0.25) == [7]


def test_star_memoizes_hot_keys(spark):
    from basketry.plans.skew import CONF_HOT_KEY_SHARE
    star = star_for(spark, SF_SMALL)
    spark.conf.set(CONF_HOT_KEY_SHARE, "0.0003")
    try:
        first = star.hot_keys("order_items", "product_id")
        assert first and star.hot_keys("order_items", "product_id") is first
    finally:
        spark.conf.unset(CONF_HOT_KEY_SHARE)
    assert star.hot_keys("order_items", "product_id") == []  # default share: nothing that large


def test_cli_lists_every_query(capsys):
    from basketry.registry import QUERIES
    from basketry.__main__ import main
    assert main(["--list"]) == 0
    assert capsys.readouterr().out.split() == list(QUERIES)

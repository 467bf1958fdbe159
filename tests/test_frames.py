"""Audits and counts that take any table, on tables of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.operators import quality, sellers
from basketry.plans.facts import by_bitmap, by_member
from basketry.registry import star_for
from scale import SF_SMALL


@pytest.fixture(scope="module")
def visits(spark):
    rows = [(1, "a", dt.datetime(2020, 1, 1, 23), 5), (2, None, dt.datetime(2020, 1, 3, 1), 0), (2, "a", None, None), (None, "b", dt.datetime(2020, 1, 2), -3)]
    return spark.createDataFrame(rows, "visit long, place string, at timestamp_ntz, spent int")


def test_date_range(visits):
    r = quality.date_range(visits, "at", "visit", "visit").first()
    assert (r.earliest_visit, r.latest_visit, r.date_span_days, r.total_visits) == (dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 3, 1), 2, 2)


def test_distribution_null_rate_and_profile(visits):
    assert [tuple(r) for r in quality.value_distribution(visits, "place").collect()] == [("a", 2, 50.0), ("b", 1, 25.0), (None, 1, 25.0)]
    assert tuple(quality.null_rate(visits, "spent").first()) == (1, 4, 25.0)
    r = quality.numeric_profile(visits, "spent").first().asDict()
    assert r == {"min_spent": -3.0, "max_spent": 5.0, "avg_spent": pytest.approx(2 / 3), "median_spent": 0.0, "p95_spent": pytest.approx(4.5), "zero_or_neg_spent": 2}
    rough = quality.numeric_profile(visits, "spent", approx=0.01).first().asDict()
    assert rough["median_spent"] == 0.0 and {k: rough[k] for k in r if k not in ("median_spent", "p95_spent")} == {k: r[k] for k in r if k not in ("median_spent", "p95_spent")}
    assert quality.numeric_profile(visits.limit(0), "spent").first().median_spent is None


def test_orphans(spark, visits):
    places = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "place string")
    got = quality.orphans(visits, places, "place", ["visit", "spent"]).collect()
    assert sorted(map(str, got)) == sorted(["Row(visit=2, spent=0)", "Row(visit=None, spent=-3)"])
    assert quality.orphan_count(visits, places, "place", "n").first().n == 2
    assert quality.orphan_count(visits.limit(0), places, "place", "n").first().n == 0


def test_members_and_bitmaps_count_what_sets_count(spark):
    rows = [(o, o % 3, [o % 7, o % 5, None], [o * 7919 % 100_000, o % 11], o) for o in range(500)] + [(501, 9, [], [], 4), (502, None, [1], [70_000], 1)]
    df = spark.createDataFrame(rows, "o long, k long, x array<long>, y array<long>, s long")
    want = {k: [sum(r[4] for r in rows if r[1] == k), sum(r[1] == k for r in rows), len({v for r in rows if r[1] == k for v in r[2]} - {None}),
                len({v for r in rows if r[1] == k for v in r[3]})] for k in {r[1] for r in rows}}
    got = by_member(df, ["k"], {"xs": "x", "ys": "y"}, ["s"]).collect()
    assert {r.k: [r.s, r.n_orders, r.xs, r.ys] for r in got} == want
    each = df.select("k", "o", "s", F.explode_outer("y").alias("m")).withColumn("s", F.when(F.col("m").isNull(), 0).otherwise(F.col("s")))
    got = by_bitmap(each, ["k"], "o", "m", ["s"], "ys").collect()
    assert {r.k: [r.n_orders, r.ys] for r in got} == {k: [v[1], v[3]] for k, v in want.items()}
    assert {r.k: r.s for r in got} == {k: sum(r[4] * len(r[3]) for r in rows if r[1] == k) for k in want}


@pytest.mark.parametrize("op", [sellers.seller_sla, sellers.state_delivery])
def test_sorted_values_give_the_same_percentiles(spark, op):
    star = star_for(spark, SF_SMALL)
    plain, by_sort = op(star), op(star, sort_values=True)
    assert plain.columns == [c for c in by_sort.columns]
    assert sorted(map(str, plain.collect())) == sorted(map(str, by_sort.collect()))


def test_running_totals_of_all_sellers(spark):
    star = star_for(spark, SF_SMALL)
    for per_bucket in (2, None):
        rows = sellers.seller_ranking(star, limit=10**6, per_bucket=per_bucket).collect()
        total = 0
        for r in rows:
            total += r.total_revenue
            assert r.cumulative_revenue == pytest.approx(total, abs=0.01)
        assert rows and rows[0].revenue_rank == 1

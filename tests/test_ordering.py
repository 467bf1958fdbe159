"""Distributed NTILE / RANK / percentile equal single-partition window results."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.plans import ordering as O


def _frame(spark, n, seed, distinct=5):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(distinct) if rng.random() > 0.1 else None, rng.random())
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, metric long, x double")


@pytest.mark.parametrize("n,tiles,per_bucket", [(1500, 5, 100), (1498, 5, 37), (7, 5, 2),
                                                (3, 5, 1), (200, 10, 13), (1, 4, 1)])
@pytest.mark.parametrize("ascending", [True, False])
def test_ntile_matches_window(spark, n, tiles, per_bucket, ascending):
    df = _frame(spark, n, n + tiles)
    key = O.asc("metric") if ascending else O.desc("metric")
    got = O.with_ntile(df, [key, O.asc("id")], tiles, "t", n, per_bucket)
    want = df.withColumn("t", F.ntile(tiles).over(Window.orderBy(key.spark_order(), F.col("id"))))
    assert sorted(got.select("id", "t").collect()) == sorted(want.select("id", "t").collect())


@pytest.mark.parametrize("n,per_bucket,distinct", [(500, 20, 3), (500, 7, 50), (60, 5, 1), (2, 1, 2)])
def test_rank_matches_window(spark, n, per_bucket, distinct):
    df = _frame(spark, n, n * distinct, distinct)
    got = O.with_rank(df, [O.desc("metric")], [O.asc("id")], "r", n, per_bucket)
    want = df.withColumn("r", F.rank().over(Window.orderBy(F.col("metric").desc_nulls_first())))
    assert sorted(got.select("id", "r").collect()) == sorted(want.select("id", "r").collect())


def test_position_is_permutation(spark):
    df = _frame(spark, 333, 1)
    got = O.with_position(df, [O.asc("x"), O.asc("id")], 333, "p", per_bucket=10)
    assert sorted(r.p for r in got.select("p").collect()) == list(range(1, 334))
    # the bucketed plan never funnels rows into a single partition
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def _scalar(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("q", [0.25, 0.5, 0.95])
def test_exact_percentile(spark, q):
    df = _frame(spark, 401, 7, 1000).filter(F.col("metric").isNotNull())
    values = [r.metric for r in df.collect()]
    assert _scalar(spark, O.exact_percentile(df, "metric", q)) == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-9)


@pytest.mark.parametrize("values", [[1.0], [None], [0.0, 1e-300, 1.0, 1e300, -1e300, 5.0], [10.0 ** (5 * i) for i in range(60)], [2.5] * 9 + [None, 2.75]])
def test_percentile_by_refinement_on_odd_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    for q in (0.0, 0.3, 0.5, 1.0):
        got = _scalar(spark, O.exact_percentile(df, "v", q))
        assert got is None if not known else got == pytest.approx(float(np.percentile(known, q * 100)), rel=1e-12)


def test_percentile_is_lazy(spark):
    """Nothing runs while the column is built, and no task sorts all values."""
    df = spark.range(1000).select(F.raise_error(F.lit("a job ran")).cast("double").alias("v"))
    O.exact_percentile(df, "v", 0.5)


@pytest.mark.parametrize("groups", [1, 7])
def test_grouped_percentiles_of_many_values(spark, groups):
    rng = np.random.default_rng(groups)
    rows = [(int(g) if g else None, float(v), int(n)) for g, v, n in zip(rng.integers(0, groups, 3000), rng.normal(size=3000), rng.integers(1, 4, 3000))]
    df = spark.createDataFrame(rows + [(99, None, 5)], "g long, v double, n long")
    got = {r.g: r for r in O.grouped_percentiles(df, ["g"], "v", "n", {"a": 0.5, "b": 0.95, "c": 0.0}).collect()}
    for g in {r[0] for r in rows}:
        values = np.repeat([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g])
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx([np.percentile(values, q) for q in (50, 95, 0)], abs=1e-12)
    assert 99 not in got


@pytest.mark.parametrize("error", [0.05, 0.005])
def test_sketch_keeps_its_rank_error(spark, error):
    values = sorted(float(v) for v in np.random.default_rng(1).lognormal(size=20_000))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    for q in (0.05, 0.5, 0.95):
        got = df.agg(O.sketch_percentile("v", q, error).alias("x")).first().x
        assert abs(np.searchsorted(values, got) - q * len(values)) <= error * len(values) + 1
    with pytest.raises(ValueError):
        O.sketch_percentile("v", 0.5, 0)


@pytest.mark.parametrize("per_bucket", [3, 40, None])
def test_running_sum_carries_between_buckets(spark, per_bucket):
    df = _frame(spark, 300, 11, 20).withColumn("amount", (F.col("id") % 17).cast("decimal(12,2)"))
    got = O.with_running_sum(df, [O.desc("metric"), O.asc("id")], "amount", "upto", 300, per_bucket)
    w = Window.orderBy(F.col("metric").desc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("upto", F.sum("amount").over(w))
    assert sorted(got.select("id", "upto").collect()) == sorted(want.select("id", "upto").collect())


def test_ntile_formula_small():
    # n < tiles: every row its own tile
    assert O.ntile_of(F.lit(3), 3, 5) is not None


def test_ntile_on_timestamp_ntz_keys(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2020, 3, 8, 1, 30) + dt.timedelta(minutes=7 * (i % 40))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    got = O.with_ntile(df, [O.desc("ts"), O.asc("id")], 7, "t", 120, per_bucket=9)
    want = df.withColumn("t", F.ntile(7).over(Window.orderBy(F.col("ts").desc(), F.col("id"))))
    assert sorted(got.select("id", "t").collect()) == sorted(want.select("id", "t").collect())


@pytest.mark.parametrize("n,per_bucket", [(700, 3), (300, 11)])
def test_search_path_matches_window(spark, n, per_bucket):
    """Hundreds of buckets: the binary search finds the same ones."""
    df = _frame(spark, n, 5, 40)
    keys = [O.desc("metric"), O.asc("id")]
    got = O.with_ntile(df, keys, 10, "t", n, per_bucket)
    want = df.withColumn("t", F.ntile(10).over(Window.orderBy(F.col("metric").desc_nulls_first(), "id")))
    assert sorted(got.select("id", "t").collect()) == sorted(want.select("id", "t").collect())
    ranked = O.with_rank(df, [O.desc("metric")], [O.asc("id")], "r", n, per_bucket)
    want_r = df.withColumn("r", F.rank().over(Window.orderBy(F.col("metric").desc_nulls_first())))
    assert sorted(ranked.select("id", "r").collect()) == sorted(want_r.select("id", "r").collect())


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_percentile_of_a_histogram(spark, q):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 60, size=500).astype(float) / 4
    hist = spark.createDataFrame([(float(v), int(c)) for v, c in zip(*np.unique(values, return_counts=True))], "v double, n long")
    got = _scalar(spark, O.selected_percentiles(hist, "v", "n", [q])[0])
    assert got == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-12)

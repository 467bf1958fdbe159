"""The refresh stream recomputes an operator when new item files arrive."""

import os
import tempfile

from basketry.operators import revenue
from basketry.registry import star_for
from basketry.sources import write_star
from scale import SF_SMALL


def test_refresh_on_arrival(spark):
    from basketry.streaming import refresh_on_arrival
    root = tempfile.mkdtemp(prefix="basketry-stream-")
    star = star_for(spark, SF_SMALL)
    write_star(star, os.path.join(root, "star"))
    out, ckpt = os.path.join(root, "out"), os.path.join(root, "ckpt")
    refresh_on_arrival(spark, os.path.join(root, "star"), revenue.period_trend, out, ckpt)
    got = spark.read.parquet(out)
    want = revenue.period_trend(star)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # a second run with no new files leaves the output untouched
    refresh_on_arrival(spark, os.path.join(root, "star"), revenue.period_trend, out, ckpt)
    assert spark.read.parquet(out).count() == want.count()

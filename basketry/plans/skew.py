"""Equi-joins that split hot keys out of the shuffle.

A fact key holding a large share of the rows (one product in a third of
all items, one order with millions of lines) would put all of those rows
into a single join task.  A key is hot when it holds more than a given
share of all rows - by default half of an even shuffle partition - so at
most 1/share keys can be hot, whatever the table's size.  They are found
with one aggregate over a sample of the fact's key column, and their rows
are joined map-side against a broadcast of just those keys' dimension rows
once these have been counted; every other key goes through the usual
shuffle join.  The two parts are disjoint by key, so their union is the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.plans.sizing import dealt

CONF_HOT_KEY_SHARE = "spark.basketry.hotKeyShare"
SAMPLED_ROWS_PER_HOT_KEY = 1000
DIM_ROWS_PER_HOT_KEY = 16  # beyond so many on average, the hot part is not broadcast


def hot_key_share(spark) -> float:
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return float(spark.conf.get(CONF_HOT_KEY_SHARE, str(0.5 / partitions)))


def hot_keys(fact: DataFrame, key: str, share: float | None = None) -> list:
    """Keys of ``fact`` with more than ``share`` of its rows, largest first.

    Counted on a sample in which a key at the threshold appears about
    SAMPLED_ROWS_PER_HOT_KEY times (candidates above half that are taken, so
    at most about 2/share keys), so only the sampled rows are shuffled.
    Missing or extra candidates never change a split join's result, only
    where its rows are joined.
    """
    share = share or hot_key_share(fact.sparkSession)
    total = fact.select(key).count()  # no column is read
    rows = fact.filter(F.col(key).isNotNull()).select(key)
    threshold = share * total
    fraction = min(1.0, SAMPLED_ROWS_PER_HOT_KEY / max(threshold, 1e-9))
    if fraction < 1.0:
        rows, threshold = rows.sample(False, fraction, 29), threshold * fraction / 2
    counts = rows.groupBy(key).count()
    return [r[key] for r in counts.filter(F.col("count") > threshold).orderBy(F.col("count").desc(), key).collect()]


def join_splitting_hot_keys(fact: DataFrame, dim: DataFrame, key: str, share: float | None = None,
                            hot: list | None = None, n: int | None = None) -> DataFrame:
    """Inner equi-join of a large ``fact`` with ``dim`` on ``key``, hot keys split out.

    ``hot`` may be given (e.g. ``Star.hot_keys`` of the table the fact comes
    from: any superset of the fact's hot keys keeps the result exact).  With
    ``n`` the shuffle join has that many partitions (see ``plans.sizing``).
    """
    hot = hot_keys(fact, key, share) if hot is None else hot
    if not hot:
        return dealt(fact, n, key).join(dealt(dim, n, key), key)
    is_hot = F.col(key).isin(hot)
    hot_dim = dim.filter(is_hot)
    if hot_dim.count() <= DIM_ROWS_PER_HOT_KEY * len(hot):
        hot_dim = F.broadcast(hot_dim)
    hot_part = fact.filter(is_hot).join(hot_dim, key)
    cold_part = dealt(fact.filter(~is_hot), n, key).join(dealt(dim.filter(~is_hot), n, key), key)
    return hot_part.unionByName(cold_part)

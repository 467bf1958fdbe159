"""Exchanges dealt by the size of the input instead of a fixed number of partitions.

An aggregate or join that Spark shuffles by itself goes to
``spark.sql.shuffle.partitions`` tasks, so at more input every task sorts and
hashes more rows.  ``partitions_for`` gives the number of partitions at which
a task gets about ``BYTES_PER_PARTITION`` of a table, from the plan's size
estimate (file sizes; no job runs), or None where the session's own number
will do; ``dealt`` deals rows to that many.  ``fold`` aggregates rows of a key
in two steps, the first over (key, salt), so that a key of very many rows is
spread over SALTS tasks before it is one row of each of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONF_BYTES_PER_PARTITION = "spark.basketry.bytesPerPartition"
BYTES_PER_PARTITION = 2 << 20  # of the estimate: 350,000 line items of the given tables
SALTS = 16
UNKNOWN = 1 << 60  # what Spark estimates where it knows no size


def partitions_for(df: DataFrame) -> int | None:
    """Partitions for exchanges of about ``df``'s rows; None if the session's shuffle partitions are as many."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = math.ceil(size / int(spark.conf.get(CONF_BYTES_PER_PARTITION, str(BYTES_PER_PARTITION))))
    return wanted if size < UNKNOWN and wanted > int(spark.conf.get("spark.sql.shuffle.partitions", "200")) else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into ``n`` partitions; as it is if ``n`` is None."""
    return df if n is None else df.repartition(n, *keys)


def salted(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """``df`` dealt by ``key`` and a salt: rows of one key go to SALTS tasks at most.  As it is if ``n`` is None."""
    if n is None:
        return df
    return df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition(n, key, "_salt")


def fold(df: DataFrame, n: int | None, key: str, by: list[str], sums: dict[str, Column], merge: bool = True) -> DataFrame:
    """``sums`` (sums or counts) per (``key``, ``by``), hash-partitioned by ``key``; rows without a key are left out if dealt.

    Without ``merge`` a group may be several rows, one of each salt, for
    callers that add them up themselves.
    """
    if n is None:
        return df.groupBy(key, *by).agg(*[c.alias(out) for out, c in sums.items()])
    parts = salted(df.filter(F.col(key).isNotNull()), n, key).groupBy(key, *by, "_salt").agg(*[c.alias(out) for out, c in sums.items()])
    parts = dealt(parts.drop("_salt"), n, key)
    if not merge:
        return parts
    types = dict(parts.dtypes)
    return parts.groupBy(key, *by).agg(*[F.sum(out).cast(types[out]).alias(out) for out in sums])

"""Re-run a batch operator whenever new files land in a star directory.

The reference has no streaming operators; this only keeps a result table
current.  A file-source stream over one star table (the trigger table,
typically ``order_items``) drives ``foreachBatch``: for every micro-batch
that brought new rows, the operator is re-run over the whole star read
from ``star_root`` and its result replaces the output.  The stream's
checkpoint (``checkpoint_location``, a shared folder on a cluster) records
which files were processed, so a restarted query resumes without reruns.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.sources.files import read_star, write_result
from basketry.sources.schema import SCHEMAS
from basketry.sources.star import Star


def refresh_on_arrival(spark: SparkSession, star_root: str, operator: Callable[[Star], DataFrame],
                       output_path: str, checkpoint_location: str, trigger_table: str = "order_items",
                       fmt: str = "parquet", available_now: bool = True):
    """Start (and, with ``available_now``, finish) the refresh stream; returns the query."""
    source = os.path.join(star_root, trigger_table)
    stream = spark.readStream.schema(SCHEMAS[trigger_table])
    stream = stream.parquet(source) if fmt == "parquet" else \
        stream.option("header", True).csv(source)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        result = operator(read_star(spark, star_root, fmt=fmt))
        write_result(result, output_path, fmt="parquet", mode="overwrite")

    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query

"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reached) of every node of ``edges (a long, b long)``.

    A large star hangs all greater neighbours of a node on its smallest one, a
    small star all smaller ones; the alternation ends with a star per component
    after logarithmically many rounds.  Edge counts never grow, smallest
    neighbours are combined map-side, and each round is written to the shared
    folder, so a lost executor costs one round at most.  Only counts reach the
    driver.
    """
    current = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = (-1, -1)
    for _ in range(rounds):
        pairs = _both(current)
        least = pairs.groupBy("a").agg(F.min(F.least("a", "b")).alias("least"))
        large = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.greatest("b", "least").alias("a"), F.col("least").alias("b")))).alias("e"))
            .select("e.*").filter("a != b").distinct())
        current = written(small, "edges")
        state = current.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))).collect()[0]
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    heads = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)

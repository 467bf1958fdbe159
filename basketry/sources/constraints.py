"""Primary keys of the star tables, checked when a table is loaded.

A check reads the key columns only: rows are folded to one per key map-side,
so a key that repeats very often is one row a task, and what comes back is
one row of counts and a few examples.  Nothing is repaired or dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from basketry.sources.schema import KEYS

EXAMPLES = 5


class KeyViolation(ValueError):
    """A table breaks its primary key; ``null_rows``, ``repeated_keys``, ``surplus_rows`` and ``examples`` say how."""

    def __init__(self, name: str, key: tuple[str, ...], null_rows: int, repeated_keys: int, surplus_rows: int, examples: list[tuple]):
        self.null_rows, self.repeated_keys, self.surplus_rows, self.examples = null_rows, repeated_keys, surplus_rows, examples
        super().__init__(f"{name}: primary key ({', '.join(key)}) broken: {null_rows} rows without a key, "
                         f"{repeated_keys} keys that repeat ({surplus_rows} rows too many), such as {examples}")


def key_violations(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row: null_rows, repeated_keys, surplus_rows, examples (the least repeated keys)."""
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    counts = df.select(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    many = (F.col("_n") > 1) & ~missing
    # the examples are the smallest keys, at most EXAMPLES of each task go on
    least = F.slice(F.sort_array(F.collect_list("_k")), 1, EXAMPLES)
    sums = counts.agg(F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0)).alias("null_rows"), F.count_if(many).alias("repeated_keys"),
                      F.coalesce(F.sum(F.when(many, F.col("_n") - 1)), F.lit(0)).alias("surplus_rows"))
    shown = counts.filter(many).select(F.struct(*key).alias("_k")).orderBy("_k").limit(EXAMPLES).agg(least.alias("examples"))
    return sums.select("*", shown.scalar().alias("examples"))


def check_key(df: DataFrame, name: str, key: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` if its key (default: the declared one of star table ``name``) has no null and no repetition, else ``KeyViolation``."""
    key = tuple(key or KEYS.get(name, ()))
    if key:
        found = key_violations(df, key).first()
        if found.null_rows or found.repeated_keys:
            raise KeyViolation(name, key, found.null_rows, found.repeated_keys, found.surplus_rows, [tuple(k) for k in found.examples])
    return df


def counting(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows and its rows without a key while whatever reads it runs; read both from the observation."""
    missing = F.lit(False)
    for c in KEYS.get(name, ()):
        missing = missing | F.col(c).isNull()
    seen = Observation(f"rows of {name}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("rows_without_key")), seen

"""Sharding by jump consistent hashing, in DataFrame expressions only.

A key's shard follows from the key and the shard count alone: a 64-bit linear
congruential generator, seeded with the key, gives the next shard count at
which the key would move, and the last one below the count is its shard.  With
one more shard, a key stays or moves to the new shard.

Long keys seed the generator themselves; other types through ``xxhash64``.  A
null key counts as the key -1, a null text as no bytes.  Slots number a
shard's rows without gaps, by bucket and then key; equal rows get slots next
to each other in any order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multiplier of the published generator, and its word and jump sizes.
MULTIPLIER, WORD, JUMP = Decimal(2862933555777941757), Decimal(1 << 64), float(1 << 31)
OVERHEAD = 8  # bytes a row takes besides its text
BUCKETS = 1024


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a bigint key among ``shards``.

    The generator's 64-bit words are unsigned decimals, as bigint products
    would overflow.  A key takes at most ``shards`` jumps, so the fold over a
    sequence of that length is the whole loop.
    """
    word = "decimal(20,0)"
    seed = F.when(key < 0, key.cast(word) + F.lit(WORD)).otherwise(key.cast(word)).cast(word)
    start = F.struct(seed.alias("key"), F.lit(0).cast("double").alias("next"), F.lit(-1).cast("double").alias("shard"))

    def step(state: Column, _: Column) -> Column:
        key = ((state["key"] * F.lit(MULTIPLIER) + F.lit(1)) % F.lit(WORD)).cast(word)
        top = F.floor(key / F.lit(Decimal(1 << 33))).cast("double")
        jump = F.floor((state["next"] + 1) * (F.lit(JUMP) / (top + 1))).cast("double")
        moved = F.struct(key.alias("key"), jump.alias("next"), state["next"].alias("shard"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["shard"].cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, and no shard in one task.

    Equal rows are counted first; (shard, bucket) groups are numbered on their
    own, and bucket totals, at most shards x buckets of them, give the offsets.
    """
    columns = rows.columns
    counted = (rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets))))
    totals = counted.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(shard, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = (Window.partitionBy(shard, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = counted.withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = numbered.join(F.broadcast(offsets), [shard, "_bucket"])  # bounded: shards x buckets rows
    first = F.col("_offset") + F.col("_first")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal documents to ``shards`` shards by their key.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law ('key'), shard,
    slot, and grown_shard: the shard among one more.
    """
    kind = docs.schema[key].dataType.typeName()
    seed = F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long")) if kind in ("long", "integer", "short", "byte") else F.xxhash64(key)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        jump_shard(seed, shards).alias("shard"), jump_shard(seed, shards + 1).alias("grown_shard"))
    return with_slots(rows, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

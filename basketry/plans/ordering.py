"""Global ordering statistics without funnelling rows into one task.

``Window.orderBy(...)`` with no partition moves every row to a single
partition.  That is fine for a few hundred aggregated rows (months, states,
categories) but not for customer- or seller-level NTILE / RANK.  Here the
total order is cut into contiguous key ranges:

1. the input size N is counted and a sample of the sort key is taken to
   choose P-1 boundary keys (kept as literals, so recomputation after an
   executor loss assigns every row to the same bucket).  P follows the rows
   alone, N / rows_per_bucket; where that is one, there is no boundary to
   look for and the steps below run over a single bucket of bounded size;
2. each row gets its bucket id by binary search over the boundaries
   (O(log P) comparisons per row, JVM-side), an ``aggregate()`` over one
   array literal (a large CASE tree makes Catalyst's rewrites very slow);
3. one hash shuffle on the bucket id, ``row_number``/``rank`` inside each
   bucket (a bounded range of keys);
4. per-bucket counts (P rows: one for 2,000,000 rows of data) give the bucket offsets,
   which are broadcast back.

A hot key value cannot overload a bucket: the sort key always ends with a
unique tie-breaker, so equal metric values are spread over as many buckets
as needed.  RANK across a bucket boundary is repaired from the per-bucket
first/last values (see :func:`with_rank`).
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, NumericType, StringType, StructField, StructType

from basketry.session import materialize

DEFAULT_ROWS_PER_BUCKET = 2_000_000
SAMPLE_PER_BUCKET = 64
CONF_ROWS_PER_BUCKET = "spark.basketry.rowsPerBucket"


@dataclass(frozen=True)
class Key:
    """One sort key; NULL placement defaults to ASC NULLS LAST / DESC NULLS FIRST."""
    name: str
    ascending: bool = True
    nulls_first: bool | None = None

    @property
    def nulls_go_first(self) -> bool:
        return (not self.ascending) if self.nulls_first is None else self.nulls_first

    def spark_order(self) -> Column:
        c = F.col(self.name)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_go_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_go_first else c.desc_nulls_last()


def asc(name, nulls_first=None) -> Key:
    return Key(name, True, nulls_first)


def desc(name, nulls_first=None) -> Key:
    return Key(name, False, nulls_first)


def rows_per_bucket(spark) -> int:
    return int(spark.conf.get(CONF_ROWS_PER_BUCKET, str(DEFAULT_ROWS_PER_BUCKET)))


def bucket_count(spark, n_rows: int, per_bucket: int | None = None) -> int:
    """Buckets of at most about ``per_bucket`` rows (default: the session's ``spark.basketry.rowsPerBucket``)."""
    return max(1, math.ceil(n_rows / (per_bucket or rows_per_bucket(spark))))


def _normalized(df: DataFrame, keys: list[Key], prefix: str):
    """Non-null columns whose ascending lexicographic order equals ``keys``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for i, k in enumerate(keys):
        c = F.col(k.name)
        dtype = types[k.name]
        flag = F.when(c.isNull(), 0 if k.nulls_go_first else 1).otherwise(1 if k.nulls_go_first else 0)
        if isinstance(dtype, NumericType):
            value = F.coalesce(c, F.lit(0).cast(dtype))
            if not k.ascending:
                value = -value
        elif isinstance(dtype, StringType):
            if not k.ascending:
                raise ValueError("descending string keys are not supported")
            value = F.coalesce(c, F.lit(""))
        else:  # dates / timestamps: order by an epoch number (no session time zone)
            kind = dtype.simpleString()
            if kind == "timestamp_ntz":
                num = (F.unix_date(F.to_date(c)).cast("bigint") * 86_400_000_000
                       + (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000
                       + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint"))
            elif kind == "timestamp":
                num = F.unix_micros(c)
            else:
                num = F.unix_date(c)
            value = F.coalesce(num, F.lit(0))
            if not k.ascending:
                value = -value
        cols.append(flag.alias(f"{prefix}f{i}"))
        cols.append(value.alias(f"{prefix}v{i}"))
    return cols


def _plain(v):
    return Decimal(v) if isinstance(v, Decimal) else v


def boundaries(base: DataFrame, keys: list[Key], n_rows: int, per_bucket: int | None = None,
               seed: int = 17) -> list[tuple]:
    """P-1 boundary keys cutting the total order into ranges of ~per_bucket rows.

    Taken from a sample of about SAMPLE_PER_BUCKET rows per bucket, so the
    part brought to the driver is bounded by P, not by the data.
    """
    n_buckets = bucket_count(base.sparkSession, n_rows, per_bucket)
    if n_buckets == 1:
        return []
    names = _key_names(keys)
    fraction = min(1.0, SAMPLE_PER_BUCKET * n_buckets / max(1, n_rows))
    sample = sorted(tuple(_plain(v) for v in row) for row in
                    base.select(*_normalized(base, keys, "_k")).select(*names)
                    .sample(False, fraction, seed).collect())
    bounds: list[tuple] = []
    for i in range(1, n_buckets):
        if not sample:
            break
        b = sample[min(len(sample) - 1, (i * len(sample)) // n_buckets)]
        if not bounds or b > bounds[-1]:
            bounds.append(b)
    return bounds


def _key_names(keys: list[Key]) -> list[str]:
    return [n for i in range(len(keys)) for n in (f"_kf{i}", f"_kv{i}")]


def long_array(values) -> Column:
    """An array<bigint> literal as one expression node (parsed once by constant folding)."""
    return F.from_json(F.lit("[" + ",".join(str(int(v)) for v in values) + "]"), ArrayType(LongType()))


def _json_value(v) -> str:
    if isinstance(v, str):
        return json.dumps(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)  # int / Decimal: exact decimal text


def _bucket_search(keyed: DataFrame, names: list[str], bounds: list[tuple]) -> DataFrame:
    """Add ``_b`` by binary search of the key among literal boundary structs.

    ``aggregate`` over ``ceil(log2(P)) + 1`` steps keeps the expression size
    constant in P (a nested CASE tree grows with P and Catalyst's
    conditional rewrites become very slow).  The search state (lo, hi) is
    packed into one bigint, so a step allocates nothing.
    """
    types = {f.name: f.dataType for f in keyed.schema.fields}
    # One string literal parsed once by constant folding: the plan holds two
    # expression nodes instead of one per boundary value.
    schema = ArrayType(StructType([StructField(n, types[n], True) for n in names]))
    text = "[" + ",".join("{" + ",".join(f'"{n}":{_json_value(v)}' for n, v in zip(names, b)) + "}"
                          for b in bounds) + "]"
    arr = F.from_json(F.lit(text), schema)
    steps = max(1, math.ceil(math.log2(len(bounds) + 1)) + 1)
    key = F.col("_key")

    def step(acc, _):
        lo, hi = F.shiftright(acc, 32), acc.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint"))
        mid = F.shiftright(lo + hi + 1, 1)
        return (F.when(lo >= hi, acc)
                .when(key < F.element_at(arr, mid.cast("int")), F.shiftleft(lo, 32) + mid - 1)
                .otherwise(F.shiftleft(mid, 32) + hi))

    search = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(len(bounds)).cast("bigint"), step,
                         lambda acc: F.shiftright(acc, 32).cast("int"))
    return keyed.withColumn("_key", F.struct(*[F.col(n) for n in names])) \
        .withColumn("_b", search).drop("_key")


def with_bucket(df: DataFrame, keys: list[Key], bounds: list[tuple]) -> DataFrame:
    """Add ``_b``: the range of the total order each row falls in (0 when no bounds)."""
    keyed = df.select("*", *_normalized(df, keys, "_k"))
    if not bounds:
        return keyed.withColumn("_b", F.lit(0))
    names = _key_names(keys)
    return _bucket_search(keyed, names, bounds)


def bucket_offsets(base: DataFrame, keys: list[Key], bounds: list[tuple]) -> Column:
    """Rows in all earlier buckets, as a literal array indexed by ``_b``.

    One small aggregate (a row per bucket) is collected; as literals the
    offsets stay identical if any stage is recomputed after a failure.
    """
    if not bounds:
        return F.lit(0)
    counts = dict(with_bucket(base.select([k.name for k in keys]), keys, bounds)
                  .groupBy("_b").count().collect())
    return running_before(counts, len(bounds) + 1)[F.col("_b")]


def running_before(counts: dict, buckets: int) -> Column:
    """Literal array of the totals of all earlier buckets."""
    return long_array(itertools.accumulate((counts.get(b, 0) for b in range(buckets - 1)), initial=0))


def with_running_sum(df: DataFrame, keys: list[Key], value: str, out: str, n_rows: int, per_bucket: int | None = None,
                     base: DataFrame | None = None) -> DataFrame:
    """Add the running sum of ``value`` (a decimal) along the total order ``keys``.

    Two levels: a running sum inside each range bucket, and the totals of the
    earlier buckets (one row per bucket) carried into it.  ``base`` as in
    :func:`with_position`.
    """
    base = df if base is None else base
    bounds = boundaries(base, keys, n_rows, per_bucket)
    keyed = with_bucket(df, keys, bounds)
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy(*[k.spark_order() for k in keys])
                               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not bounds:
        return keyed.select(*df.columns, inside.alias(out))
    totals = with_bucket(base.select(*[k.name for k in keys], F.col(value).alias("_value")), keys, bounds).groupBy("_b").agg(F.sum("_value").alias("_total"))
    carried = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carry = totals.select("_b", F.sum("_total").over(carried).alias("_carry"))
    return (keyed.withColumn("_in", inside).join(F.broadcast(carry), "_b")
            .select(*df.columns, F.coalesce(F.col("_carry") + F.col("_in"), "_carry", "_in").alias(out)))


def with_position(df: DataFrame, keys: list[Key], n_rows: int, out: str = "_pos",
                  per_bucket: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """Add the 1-based position of every row in the total order ``keys``.

    ``keys`` must end with a unique tie-breaker so that the order is total.
    ``base`` (default ``df``) is a materialized frame with the same rows,
    used for sampling and counting so chained calls do not recompute.
    """
    base = df if base is None else base
    bounds = boundaries(base, keys, n_rows, per_bucket)
    order = [k.spark_order() for k in keys]
    keyed = with_bucket(df, keys, bounds)
    rn = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    res = keyed.withColumn(out, bucket_offsets(base, keys, bounds) + rn)
    return res.select(*df.columns, F.col(out).cast("bigint").alias(out))


def with_ntiles(df: DataFrame, specs: dict[str, tuple[list[Key], int]], n_rows: int,
                per_bucket: int | None = None) -> DataFrame:
    """Several NTILE columns over independent total orders of the (materialized) rows of ``df``.

    ``specs`` maps output column -> (keys ending with a unique tie-breaker,
    tiles).  All orderings share one sample pass (boundaries); the rows are
    tagged with the bucket of every ordering once, and both the counts (one
    aggregate) and the windows read the tagged rows.
    """
    keys_of = {name: keys for name, (keys, _) in specs.items()}
    bounds = _shared_boundaries(df, keys_of, bucket_count(df.sparkSession, n_rows, per_bucket), n_rows)
    out, counts = df, {}
    if any(bounds.values()):
        for i, (name, keys) in enumerate(keys_of.items()):
            out = with_bucket(out, keys, bounds[name]).withColumnRenamed("_b", f"_b{i}").drop(*_key_names(keys))
        out = materialize(out)
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.col(f"_b{i}").alias("b")) for i in range(len(specs))]))
        for r in out.select(pairs.alias("p")).select("p.o", "p.b").groupBy("o", "b").count().collect():
            counts.setdefault(r.o, {})[r.b] = r["count"]
    else:
        out = df.select("*", *[F.lit(0).alias(f"_b{i}") for i in range(len(specs))])
    for i, (name, (keys, tiles)) in enumerate(specs.items()):
        within = F.row_number().over(Window.partitionBy(f"_b{i}").orderBy(*[k.spark_order() for k in keys]))
        before = running_before(counts[i], len(bounds[name]) + 1)[F.col(f"_b{i}")] if i in counts else F.lit(0)
        out = out.withColumn(name, ntile_of(before + within, n_rows, tiles))
    return out.select(*df.columns, *specs)


def _shared_boundaries(df: DataFrame, keys_of: dict[str, list[Key]], n_buckets: int, n_rows: int) -> dict[str, list[tuple]]:
    """Boundary keys of several orderings from one sample (about SAMPLE_PER_BUCKET rows per bucket)."""
    if n_buckets == 1:
        return {name: [] for name in keys_of}
    normal = {name: [c.alias(f"_s{i}_{j}") for j, c in enumerate(_normalized(df, keys, "_k"))]
              for i, (name, keys) in enumerate(keys_of.items())}
    fraction = min(1.0, SAMPLE_PER_BUCKET * n_buckets / max(1, n_rows))
    rows = df.select(*[c for cols in normal.values() for c in cols]).sample(False, fraction, 17).collect()
    out, start = {}, 0
    for name, cols in normal.items():
        sample = sorted(tuple(_plain(v) for v in r[start:start + len(cols)]) for r in rows)
        start += len(cols)
        cuts = [sample[min(len(sample) - 1, i * len(sample) // n_buckets)] for i in range(1, n_buckets)] if sample else []
        out[name] = [c for i, c in enumerate(cuts) if i == 0 or c > cuts[i - 1]]
    return out


def ntile_of(position: Column, n_rows: int, tiles: int) -> Column:
    """NTILE(tiles) from a 1-based position among ``n_rows`` rows."""
    q, r = divmod(n_rows, tiles)
    big = r * (q + 1)
    p = position
    first = F.floor((p - 1) / (q + 1)) + 1
    if q == 0:
        return first.cast("bigint")
    return F.when(p <= big, first).otherwise(r + F.floor((p - big - 1) / q) + 1).cast("bigint")


def with_ntile(df: DataFrame, keys: list[Key], tiles: int, out: str, n_rows: int,
               per_bucket: int | None = None, base: DataFrame | None = None) -> DataFrame:
    pos = with_position(df, keys, n_rows, "_pos", per_bucket, base)
    return pos.withColumn(out, ntile_of(F.col("_pos"), n_rows, tiles)).drop("_pos")


def with_rank(df: DataFrame, rank_keys: list[Key], tiebreak: list[Key], out: str,
              n_rows: int, per_bucket: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """SQL RANK() over ``rank_keys`` (ties share the lowest position).

    Buckets cut the total order (rank keys + tie-breaker), so a tie run can
    span buckets; a bucket whose first value continues the run that ended
    an earlier bucket takes that run's start position.
    """
    keys = list(rank_keys) + list(tiebreak)
    bounds = boundaries(df if base is None else base, keys, n_rows, per_bucket)
    order = [k.spark_order() for k in rank_keys]
    keyed = with_bucket(df, keys, bounds)
    if not bounds:
        return keyed.select(*df.columns, F.rank().over(Window.partitionBy("_b").orderBy(*order)).cast("bigint").alias(out))
    value = F.struct(*[F.col(c) for c in _key_names(keys)[: 2 * len(rank_keys)]])
    local = (keyed.withColumn("_lr", F.rank().over(Window.partitionBy("_b").orderBy(*order)))
             .withColumn("_val", value))
    stats = local.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_val").alias("_first"),
                                    F.max("_val").alias("_last"), F.max("_lr").alias("_last_run"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    ends = stats.groupBy(F.col("_last").alias("_v")).agg(
        F.min(F.col("_off") + F.col("_last_run")).alias("_carry"))
    stats = stats.join(ends, stats["_first"] == ends["_v"], "left").select(
        "_b", "_off", "_first", "_carry")
    res = local.join(F.broadcast(stats), "_b").withColumn(
        out, F.when((F.col("_val") == F.col("_first")) & F.col("_carry").isNotNull(), F.col("_carry"))
        .otherwise(F.col("_off") + F.col("_lr")))
    return res.select(*df.columns, F.col(out).cast("bigint").alias(out))


CELLS = 1 << 16  # parts of an interval in one refinement
REFINEMENTS = 2  # 2**32 parts in all; what is left of them is sorted


def selected_percentile(hist: DataFrame, value: str, weight: str, q: float) -> DataFrame:
    """PERCENTILE_CONT(q) over a histogram (distinct value, row count), as a plan of one row: ``percentile`` (double).

    The interval of values that holds the wanted place is cut into CELLS parts
    again and again; a refinement adds up the weights of the parts (at most
    CELLS rows, the only rows of its unpartitioned window) and goes on with
    the values of the part the place falls in.  Every step ends in a one-row
    frame that is joined back, so nothing runs while the query is built, and
    the histogram's exchange is shared by all steps.  NULL values are left
    out; without values the result is NULL.
    """
    rows = hist.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), F.col(weight).cast("bigint").alias("_w"))
    state = rows.agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(
        "_lo", "_hi", F.lit(0).cast("bigint").alias("_skip"), F.floor((F.col("_n") - 1) * q).cast("bigint").alias("_at"),
        ((F.col("_n") - 1) * q).alias("_place"))
    for _ in range(REFINEMENTS):
        width = F.col("_hi") - F.col("_lo")
        cell = F.when(width > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("_v") - F.col("_lo")) / width * CELLS))).otherwise(0).cast("int")
        parts = (rows.crossJoin(F.broadcast(state)).filter("_v between _lo and _hi")
                 .groupBy("_skip", "_at", "_place", cell.alias("_cell")).agg(F.sum("_w").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows
        parts = parts.withColumn("_skip", F.col("_skip") + F.coalesce(F.sum("_w").over(upto), F.lit(0)))
        state = parts.filter("_skip <= _at and _at < _skip + _w").select("_lo", "_hi", "_skip", "_at", "_place")
    # few values are left (of one cell in 2**32; more only where sizes differ by many powers of ten), and the next one above
    upto = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = rows.crossJoin(F.broadcast(state))
    ends = (left.filter("_v between _lo and _hi").withColumn("_upto", F.col("_skip") + F.sum("_w").over(upto))
            .agg(F.min(F.when(F.col("_upto") > F.col("_at"), F.col("_v"))).alias("_a"),
                 F.min(F.when(F.col("_upto") > F.col("_at") + 1, F.col("_v"))).alias("_b"), F.max(F.col("_place") - F.col("_at")).alias("_part")))
    # (weights are positive; with them in it, this step reads the same exchange as the others)
    above = left.filter("_v > _hi and _w > 0").agg(F.min("_v").alias("_c"))
    upper = F.coalesce("_b", "_c", "_a")
    return ends.crossJoin(F.broadcast(above)).select((F.col("_a") + (upper - F.col("_a")) * F.col("_part")).alias("percentile"))


def selected_percentiles(hist: DataFrame, value: str, weight: str, qs: list[float]) -> list[Column]:
    """Exact percentiles of a histogram as scalar columns."""
    return [selected_percentile(hist, value, weight, q).scalar() for q in qs]


def exact_percentile(df: DataFrame, value: str, q: float) -> Column:
    """PERCENTILE_CONT(q) of ``value`` (NULLs ignored) over all rows of ``df`` as a scalar column."""
    return selected_percentile(df.groupBy(value).agg(F.count(F.lit(1)).alias("_w")), value, "_w", q).scalar()


def sketch_percentile(value, q: float, error: float) -> Column:
    """Aggregate: the q-quantile from a mergeable sketch; its rank among n values is off by ``error * n`` at most.

    No interpolation: the result is one of the values.
    """
    if not 0 < error < 1:
        raise ValueError("the rank error lies between 0 and 1")
    return F.percentile_approx(value, q, math.ceil(1 / error))


def grouped_percentiles(df: DataFrame, keys: list[str], value: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """Exact PERCENTILE_CONT of ``value`` per group: a row of ``keys`` with a column per entry of ``qs``.

    For columns with very many distinct values per group, whose value maps
    (``percentile``) would not fit: rows are folded to (group, value) counts,
    sorted by value within their group, and running counts along the sort
    tell which of them hold the wanted places.  Sorting spills; no group is
    held in memory.  Groups without a value are left out.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    group = Window.partitionBy(*keys)
    along = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hist.withColumn("_upto", F.sum("_w").over(along)).withColumn("_n", F.sum("_w").over(group))
    out = []
    for name, q in qs.items():
        place = (F.col("_n") - 1) * q

        def at(p):
            return F.max(F.when((F.col("_upto") - F.col("_w") <= p) & (p < F.col("_upto")), F.col(value).cast("double")))
        low = at(F.floor(place))
        out.append((low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))).alias(name))
    return placed.groupBy(*keys).agg(*out)

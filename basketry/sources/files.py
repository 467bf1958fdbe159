"""Parquet / CSV readers and writers for the star and for operator results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from basketry.sources.constraints import check_key
from basketry.sources.schema import KEYS, SCHEMAS
from basketry.sources.star import STAR_TABLES, Star

# Fixed value: timestamp text format of the CSV exports (no zone, no 'T').
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _path(spark: SparkSession, root: str, name: str, fmt: str) -> str:
    """``<root>/<name>.<fmt>`` if the root's file system has it, else ``<root>/<name>``."""
    single = f"{root.rstrip('/')}/{name}.{fmt}"
    path = spark._jvm.org.apache.hadoop.fs.Path(single)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return single if found else f"{root.rstrip('/')}/{name}"


def _from_header(raw: DataFrame, schema: StructType, name: str, ids: str) -> DataFrame:
    """The declared columns of a CSV frame of strings, taken by header name."""
    lacking = [f.name for f in schema if f.name not in raw.columns]
    if lacking:
        raise ValueError(f"{name}: the header lacks {lacking}")
    out = []
    for f in schema:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType) or ids == "string" and f.name.endswith("_id") and isinstance(f.dataType, LongType):
            out.append(value)
        elif isinstance(f.dataType, TimestampNTZType):
            out.append(F.to_timestamp_ntz(F.nullif(value, F.lit("")), F.lit(CSV_TIMESTAMP_FORMAT)).alias(f.name))
        else:
            out.append(F.nullif(value, F.lit("")).cast(f.dataType).alias(f.name))
    return raw.select(*out)


CORRUPT = "_corrupt_record"
TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


@dataclass(frozen=True)
class Loaded:
    """Rows that loaded, and those that did not: ``source`` (the line, or its fields as JSON) and ``reasons``."""
    accepted: DataFrame
    rejected: DataFrame


def read_csv_with_rejects(spark: SparkSession, root: str, name: str, blank_category: str = "keep", ids: str = "long",
                          reject_to: str | None = None) -> Loaded:
    """Read a star table's CSV, setting bad rows aside instead of stopping.

    A row is rejected for each of these reasons: it has more or fewer fields
    than the header (``malformed``), a value is not of its column's type
    (``<column>: not a <type>``), or a part of the primary key is missing
    (``<column>: no key``).  Both frames come from one permissive read; with
    ``reject_to`` the rejected rows are written there as Parquet and read
    back.  Count them with ``rejected.count()`` or per reason with
    ``rejects_by_reason``.
    """
    schema, path = SCHEMAS[name], _path(spark, root, name, "csv")
    options = {"header": True, "sep": ",", "nullValue": "\u0001", "emptyValue": ""}
    names = spark.read.options(**options).csv(path).columns
    lacking = [f.name for f in schema if f.name not in names]
    if lacking:
        raise ValueError(f"{name}: the header lacks {lacking}")
    # every field is parsed whatever is selected: a pruned read would not see that a line has too few
    texts = StructType([StructField(c, StringType()) for c in [*names, CORRUPT]])
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False).schema(texts).csv(path)
    values, reasons = [], [F.when(F.col(CORRUPT).isNotNull(), "malformed")]
    for f in schema:
        text = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType) or ids == "string" and f.name.endswith("_id") and isinstance(f.dataType, LongType):
            value = text
        else:
            given = F.nullif(text, F.lit(""))
            value = given.try_cast(f.dataType)
            if isinstance(f.dataType, TimestampNTZType):
                value = F.when(given.rlike(TIMESTAMP_PATTERN), value)
            reasons.append(F.when(F.col(CORRUPT).isNull() & given.isNotNull() & value.isNull(), f"{f.name}: not a {f.dataType.simpleString()}"))
        if f.name in KEYS.get(name, ()):
            reasons.append(F.when(F.col(CORRUPT).isNull() & F.nullif(text, F.lit("")).isNull(), f"{f.name}: no key"))
        values.append(value.alias(f.name))
    source = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    read = raw.select(*values, F.array_compact(F.array(*reasons)).alias("_reasons"), source.alias("_source"))
    accepted = read.filter(F.size("_reasons") == 0).select(*[f.name for f in schema])
    rejected = read.filter(F.size("_reasons") > 0).select(F.col("_source").alias("source"), F.col("_reasons").alias("reasons"))
    if name == "products" and blank_category == "null":
        accepted = accepted.withColumn("product_category_name", F.nullif(F.col("product_category_name"), F.lit("")))
    if reject_to:
        rejected.write.mode("overwrite").parquet(reject_to)
        rejected = spark.read.schema(rejected.schema).parquet(reject_to)
    return Loaded(accepted, rejected)


def rejects_by_reason(rejected: DataFrame) -> DataFrame:
    """reason, rows: a row with several reasons counts for each."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "reason")


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet",
               blank_category: str = "keep", ids: str = "long", check_keys: bool = False) -> DataFrame:
    """Read one star table with its declared schema.

    ``check_keys`` raises ``KeyViolation`` for a table whose primary key has
    nulls or repeats (a pass over the key columns, ``sources.constraints``).

    CSV exports (header, comma separated) are read by header name, so column
    order and further columns do not matter; a missing column or a value that
    is not of its type is an error.  ``ids='string'`` keeps text ids (such as
    32-character hashes) as they are, ``'long'`` casts them.
    An unquoted empty field is NULL and a quoted one (``""``) is the empty
    string: Spark's default ``nullValue`` is '' and would fold both into
    NULL, so a sentinel that never occurs in data is used instead.
    ``blank_category='null'`` then turns empty category strings into NULL,
    ``'keep'`` leaves them as ''.
    """
    schema = SCHEMAS[name]
    path = _path(spark, root, name, fmt)
    if fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
    elif fmt == "csv":
        raw = (spark.read.option("header", True).option("sep", ",").option("mode", "FAILFAST")
               .option("nullValue", "\u0001").option("emptyValue", "").csv(path))
        df = _from_header(raw, schema, name, ids)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    if name == "products" and blank_category == "null":
        df = df.withColumn("product_category_name",
                           F.nullif(F.col("product_category_name"), F.lit("")))
    return check_key(df, name) if check_keys else df


def read_star(spark: SparkSession, root: str, fmt: str = "parquet",
              blank_category: str = "keep", ids: str = "long", check_keys: bool = False) -> Star:
    return Star(**{name: read_table(spark, root, name, fmt, blank_category, ids, check_keys)
                   for name in STAR_TABLES})


def write_star(star: Star, root: str, fmt: str = "parquet",
               mode: str = "overwrite") -> None:
    """Persist the star; orders-keyed fact tables are partitioned by nothing
    and written as plain files so any engine can read them back."""
    for name, df in star.items():
        write_result(df, f"{root.rstrip('/')}/{name}", fmt=fmt, mode=mode)


def write_result(df: DataFrame, path: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("timestampNTZFormat", CSV_TIMESTAMP_FORMAT).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")

"""Results of several queries in one file, one below the other, as spreadsheets leave them.

Such a file has one header at most, rows padded with commas to one width,
line ends of either kind, and integers shown as dates where a column was
formatted so (day 2016 of the spreadsheet calendar reads 1905-07-08, day 0
reads 1900-01-00).  A section is told by a pattern of its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIAL = "serial"  # an integer that may read as a spreadsheet date
# Fixed values of the spreadsheet calendar: day 1 is 1900-01-01, and a 29 February 1900 is counted that never was.
DAY_60 = "1900-03-01"  # the first day that the missing 29 February moves: day 61


@dataclass(frozen=True)
class Section:
    """Lines that match ``pattern`` (Java regular expression) with ``columns`` (name, type or SERIAL) from the left."""
    name: str
    pattern: str
    columns: tuple[tuple[str, str], ...]


def serial_number(text: Column) -> Column:
    """The integer behind a number or a spreadsheet date (``1900-01-00`` is 0)."""
    day = F.when(text.endswith("-00"), F.lit(0)).otherwise(
        F.datediff(text.try_cast("date"), F.lit("1899-12-31").cast("date")) + F.when(text >= DAY_60, 1).otherwise(0))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise(text.try_cast("bigint")).cast("bigint")


def read_sections(spark: SparkSession, path: str, sections: list[Section], header: bool = True) -> dict[str, DataFrame]:
    """Section name -> its rows, with ``line`` (from 0) first; a value that is not of its type is an error.

    The whole file is one report and is read as one text; a line that matches
    no section is an error when the section ``""`` of such lines is not
    empty: it is returned with them (line, text), blank lines left out.
    """
    lines = (spark.read.text(path, wholetext=True)
             .select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line", "text"))
             .filter((F.length(F.regexp_replace("text", "[, ]", "")) > 0) & (F.col("line") >= int(header))))
    which = F.lit(None).cast("string")
    for section in reversed(sections):
        which = F.when(F.col("text").rlike(section.pattern), section.name).otherwise(which)
    told = lines.withColumn("section", which)
    fields = F.split("text", ",")
    out = {"": told.filter("section is null").select("line", "text")}
    for section in sections:
        columns = []
        for i, (name, kind) in enumerate(section.columns):
            value = F.nullif(F.get(fields, F.lit(i)), F.lit("")) if kind != "string" else F.get(fields, F.lit(i))
            columns.append((serial_number(value) if kind == SERIAL else value.cast(kind)).alias(name))
        out[section.name] = told.filter(F.col("section") == section.name).select("line", *columns)
    return out

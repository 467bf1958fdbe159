"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "EXCLUDED_STATUSES", "DELIVERED", "col", "is_valid", "is_delivered",
    "gmv", "month_start", "day_diff", "month_diff", "dow0", "day_name",
    "pct", "ratio", "avg_of", "money", "is_late", "flag_sum", "as_long",
    "round_exact", "period_start", "rounded",
]

# Order statuses that make an order invalid for revenue,
# and the status that marks a completed delivery.
EXCLUDED_STATUSES = ("canceled", "unavailable")
DELIVERED = "delivered"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid(status="order_status") -> Column:
    """Status NOT IN the excluded list (NULL status is not valid)."""
    return ~col(status).isin(*EXCLUDED_STATUSES)


def is_delivered(status="order_status") -> Column:
    return col(status) == DELIVERED


def gmv(price="price", freight="freight_value") -> Column:
    return col(price) + col(freight)


def period_start(ts, grain: str = "month") -> Column:
    """First instant of the week, month, quarter or year as timestamp without zone.

    Truncates the calendar date, so no session time zone is involved
    (``date_trunc`` would round-trip through a zoned timestamp).
    """
    if grain not in ("week", "month", "quarter", "year"):
        raise ValueError(f"unknown grain {grain!r}")
    return F.trunc(F.to_date(col(ts)), grain).cast("timestamp_ntz")


def month_start(ts) -> Column:
    return period_start(ts, "month")


def day_diff(start, end) -> Column:
    """Number of day boundaries between two instants (end - start)."""
    return F.datediff(F.to_date(col(end)), F.to_date(col(start)))


def month_diff(start, end) -> Column:
    """Number of month boundaries between two instants (end - start)."""
    s, e = col(start), col(end)
    return (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)


def dow0(ts) -> Column:
    """Day of week with 0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(col(ts)) - 1


def day_name(ts) -> Column:
    """English day name blank-padded to 9 characters ('Sunday   ')."""
    return F.rpad(F.date_format(col(ts), "EEEE"), 9, " ")


def rounded(c, scale: int) -> Column:
    """Half-up rounding of a double quotient: an amount over a count that is an
    exact tie (21511.46 / 68 = 316.345) may lie an ulp below it, so noise is
    stripped at 9 places first."""
    return F.round(F.round(col(c), 9), scale)


def pct(num, den, scale: int) -> Column:
    """round(num * 100 / den, scale) in double; NULL when den is 0/NULL."""
    return rounded(col(num).cast("double") * 100.0
                   / F.nullif(col(den), F.lit(0)).cast("double"), scale)


def ratio(num, den) -> Column:
    """num / den in double; NULL when den is 0/NULL."""
    return col(num).cast("double") / F.nullif(col(den), F.lit(0)).cast("double")


def avg_of(c) -> Column:
    """Aggregate mean as exact sum / count in double (matches SQL AVG)."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def money(c) -> Column:
    """Exact decimal amount, rounded half-up to cents, emitted as double."""
    return F.round(col(c), 2).cast("double")


def is_late(delivered="order_delivered_customer_date",
            estimated="order_estimated_delivery_date") -> Column:
    """1 when delivered after the estimate, else 0 (NULL compare -> 0)."""
    return F.when(col(delivered) > col(estimated), 1).otherwise(0)


def flag_sum(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): NULL on empty input."""
    return F.sum(F.when(cond, 1).otherwise(0))


def as_long(c) -> Column:
    return col(c).cast("bigint")


def round_exact(c, scale: int) -> Column:
    """Round a value whose exact result has few decimals (an interpolated
    percentile of integers has at most two): strip binary noise at 6
    places first, then round half-up to ``scale``."""
    return F.round(F.round(col(c), 6), scale)

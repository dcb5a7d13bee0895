"""Column builders. Ratios are computed in doubles, counts are longs."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

MERGED = "merged"


def is_merged() -> Column:
    return F.col("state") == MERGED


def merged_count() -> Column:
    return F.coalesce(F.sum(F.when(is_merged(), 1).otherwise(0)), F.lit(None)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a double; null where whole is 0."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def merge_rate(digits: int = 1) -> Column:
    return F.round(percent(merged_count(), F.count("*")), digits)


def average(column: str, digits: int = 1) -> Column:
    return F.round(F.avg(column), digits)


def average_merged(column: str, digits: int = 1) -> Column:
    """The mean over merged rows only."""
    return F.round(F.avg(F.when(is_merged(), F.col(column))), digits)


def count_true(condition: Column) -> Column:
    """Rows for which the condition holds; null if there is no row at all, as SQL's SUM."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def week(column: str = "created_at") -> Column:
    """The Monday that starts the row's week."""
    return F.date_trunc("week", F.col(column))


def month(column: str = "created_at") -> Column:
    return F.date_trunc("month", F.col(column))


def size_bucket(size: Column) -> Column:
    """Up to 50 is small, up to 200 medium; larger ones, and null, are large."""
    return F.when(size <= 50, "Small (<50)").when(size <= 200, "Medium (50-200)").otherwise("Large (>200)")


def size_order(bucket: Column) -> Column:
    return F.when(bucket == "Small (<50)", 1).when(bucket == "Medium (50-200)", 2).otherwise(3)


def trend(d_count: Column, d_rate: Column, steady: int, mixed_signals: bool) -> Column:
    """Label of the change against the row read before; empty where there is none.

    ``steady`` is the largest change in count that is still stable; ``mixed_signals`` tells
    volume and quality that move apart from other mixed changes.
    """
    label = (
        F.when(d_count.isNull(), "")
        .when((d_count > 0) & (d_rate >= 0), "up")
        .when((d_count < 0) & (d_rate < -5), "down")
        .when((F.abs(d_count) <= steady) & (F.abs(d_rate) <= 5), "stable")
    )
    if mixed_signals:
        label = label.when((d_count > 0) & (d_rate < -5), "up_lower_quality").when(
            (d_count < 0) & (d_rate > 5), "down_better_quality"
        )
    return label.otherwise("mixed")


def change(column: str, window: WindowSpec) -> Column:
    """Difference from the previous row of the window, in doubles."""
    return F.col(column).cast("double") - F.lag(F.col(column).cast("double")).over(window)


def rate_band(rate: Column, middle: float) -> Column:
    return F.when(rate >= 90, "green").when(rate >= middle, "yellow").otherwise("red")


def time_band(hours: Column) -> Column:
    """Null hours have no band."""
    return F.when(hours.isNull(), None).when(hours < 24, "green").when(hours < 72, "yellow").otherwise("red")


def bar(filled: Column, width: int) -> Column:
    """``filled`` full blocks out of ``width``; parts of a block are not drawn."""
    n = F.floor(filled).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def day_span(low: Column, high: Column) -> Column:
    """Whole elapsed days plus one: not calendar days."""
    micros = F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))
    return (F.floor(micros / F.lit(86_400_000_000)) + 1).cast("long")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)).cast("double") / F.lit(3.6e9)


def sanitized_org(name: Column) -> Column:
    """Lower case, with spaces and underscores as hyphens."""
    return F.regexp_replace(F.lower(name), "[ _]", "-")


def cutoff(days_back: int | None, as_of: datetime | date | None = None) -> date | None:
    """The first day in scope; None if the scope is not limited."""
    if not days_back:
        return None
    now = as_of or datetime.now()
    day = now.date() if isinstance(now, datetime) else now
    return day - timedelta(days=days_back)

"""Calendar dimension and date-valued column helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the calendar dimension (must equal the reference's labels).
MONTH_END_LABEL = "Month End"
FY_END_LABEL = "Financial Year End"
FY_PREFIX = "FY"
FY_FIRST_MONTH = 4          # UK financial year runs April .. March
FY_END_MONTH, FY_END_DAY = 3, 31


def date_key(d: Column) -> Column:
    """YYYYMMDD integer surrogate key of a date column."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def financial_year(d: Column) -> Column:
    """``FYyy`` label: April of year yy-1 .. March of year yy."""
    end_year = F.year(d) + F.when(F.month(d) >= FY_FIRST_MONTH, 1).otherwise(0)
    return F.concat(F.lit(FY_PREFIX), F.lpad((end_year % 100).cast("string"), 2, "0"))


def calendar(spark: SparkSession, start: str | _dt.date, end: str | _dt.date) -> DataFrame:
    """Dense calendar dimension, one row per day in [start, end].

    Built from a single ``sequence`` explode, so it costs one task and no input
    scan; its size is bounded by the date range (about 36.5k rows per century),
    which is what makes it safe to broadcast.
    """
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))).alias("date"))
    d = F.col("date")
    return days.select(
        date_key(d).alias("date_key"),
        d,
        F.year(d).cast("int").alias("year"),
        F.month(d).cast("int").alias("month"),
        F.dayofmonth(d).cast("int").alias("day"),
        year_month(d).alias("year_month"),
        financial_year(d).alias("financial_year"),
        F.when(d == F.last_day(d), F.lit(MONTH_END_LABEL)).alias("month_end_indicator"),
        F.when((F.month(d) == FY_END_MONTH) & (F.dayofmonth(d) == FY_END_DAY),
               F.lit(FY_END_LABEL)).alias("financial_year_end_indicator"),
    )


def parse_uk_date(c: Column) -> Column:
    """Day/month/year text (one or two digits, four for the year) to date; blank or malformed to null
    (the caller splits rejects)."""
    text = F.trim(c)
    return F.when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(text, "d/M/yyyy"))


def month_ends_between(start: Column, end: Column) -> Column:
    """Array of calendar month-end dates ``me`` with start <= me <= end (empty if none)."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    ends = F.transform(months, lambda m: F.last_day(m))
    return F.when(start <= end, F.filter(ends, lambda me: (me >= start) & (me <= end))) \
        .otherwise(F.array().cast("array<date>"))


def fy_range_filter(df: DataFrame, fy_from: str | None = None, fy_to: str | None = None,
                    col: str = "financial_year") -> DataFrame:
    """Inclusive string range on ``FYyy`` labels, each bound optional."""
    if fy_from is not None:
        df = df.filter(F.col(col) >= F.lit(fy_from))
    if fy_to is not None:
        df = df.filter(F.col(col) <= F.lit(fy_to))
    return df


def years_before(day: str, years: int) -> str:
    """The same day some years earlier (28 February for a 29th that isn't there)."""
    d = _dt.date.fromisoformat(day)
    try:
        return f"{d.replace(year=d.year - years)}"
    except ValueError:
        return f"{d.replace(year=d.year - years, day=28)}"

"""Numeric helpers shared by every report column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAP_SCALE = 6   # decimal places kept when snapping a double before rounding


def dround(c: Column, n: int) -> Column:
    """Round half away from zero on the decimal value of ``c``.

    Plain ``round`` on a double is at the mercy of its binary expansion (12.35
    is stored just below 12.35). Snapping to a 6-place decimal first makes the
    result depend only on the decimal number the double stands for, which is
    what the reports mean (and what re-rounding a 2-place money or percentage
    value to 1 or 0 places needs).
    """
    return F.round(c.cast(f"decimal(38,{SNAP_SCALE})"), n).cast("double")


def sql_dround(expr: str, n: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,{SNAP_SCALE})), {n}) AS DOUBLE)"


# Money and units are held as doubles, and sums of doubles depend on the order of the rows. As decimals of this
# type they add up exactly, whatever the partitions; the finer type is for products of returns and weights.
MONEY_TYPE = "decimal(18,6)"
FINE_TYPE = "decimal(30,12)"


def exact_sum(c: Column | str, kind: str = MONEY_TYPE) -> Column:
    """Sum of a double column that is the same for every order and partitioning of the rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(kind)).cast("double")


def exact_sum_over(c: Column | str, window, kind: str = MONEY_TYPE) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(kind)).over(window).cast("double")

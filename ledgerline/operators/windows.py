"""Window operators: running sums, trailing compounded returns and Sharpe ratios,
rebasing, cumulative products, period-end down-sampling (E1-E13).

Every window here is partitioned by an entity key and ordered by a date, after
the rows were pre-aggregated to one per (entity, date). A partition therefore
holds at most one row per calendar day (or month) of that entity, whatever
the size of the input, so no single task ever receives a whole hot key's raw
rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import exact_sum_over

# Fixed values of the trailing-metric definitions.
TRAILING_SHORT = 12          # months
TRAILING_LONG = 36           # months
ANNUALISE_LONG = 1.0 / 3.0   # 36 months -> per year
SHARPE_SCALE = math.sqrt(12.0)


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Cumulative sum in ROWS unbounded..current (rows unique per key and order)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, exact_sum_over(value, w))


def lag_value(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """E5: previous row's value (gaps are jumped, as rows not months)."""
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def log1p_or_null(r: Column) -> Column:
    """ln(1+r), null when 1+r <= 0 (the log is undefined there)."""
    return F.when(F.lit(1.0) + r > 0, F.log(F.lit(1.0) + r))


def trailing_metrics(df: DataFrame, keys: Sequence[str], order: str, ret: str) -> DataFrame:
    """Trailing 12m compounded return, 36m annualised return, 12m/36m Sharpe.

    Windows count rows (not months). Each metric is null until the window holds
    12 (36) rows; Sharpe is also null when the sample standard deviation is 0.
    Catalyst folds the two frames into two Window operators over one sort.
    """
    base = Window.partitionBy(*keys).orderBy(order)
    out = df
    for n, suffix in ((TRAILING_SHORT, "12m"), (TRAILING_LONG, "36m")):
        w = base.rowsBetween(-(n - 1), Window.currentRow)
        cnt = F.count(F.lit(1)).over(w)
        growth = F.exp(F.sum(log1p_or_null(F.col(ret))).over(w))
        sd = F.stddev_samp(ret).over(w)
        mean = F.avg(ret).over(w)
        if n == TRAILING_SHORT:
            out = out.withColumn(f"trailing_{suffix}_return", F.when(cnt >= n, growth - 1))
        else:
            out = out.withColumn(f"trailing_{suffix}_return_annualised",
                                 F.when(cnt >= n, F.pow(growth, F.lit(ANNUALISE_LONG)) - 1))
        out = out.withColumn(f"trailing_{suffix}_sharpe",
                             F.when((cnt >= n) & (sd != 0), mean / sd * F.lit(SHARPE_SCALE)))
    return out


def rebase_to_first(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                    scale: float = 100.0) -> DataFrame:
    """Value / first value of the series * 100 (null if the base is 0)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.try_divide(F.col(value), F.first(value).over(w)) * F.lit(scale))


def cumprod_index(df: DataFrame, keys: Sequence[str], order: str, ret: str, out: str,
                  base: float = 100.0) -> DataFrame:
    """Base * prod(1 + r) as exp(sum(ln(1 + r))) over the running frame."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.exp(F.sum(log1p_or_null(F.col(ret))).over(w)) * F.lit(base))


def period_end_downsample(df: DataFrame, keys: Sequence[str], date: str, period_fmt: str = "yyyy-MM") -> DataFrame:
    """Keep the last point of each period (default: calendar month) per series."""
    cols = df.columns
    period = F.date_format(F.col(date), period_fmt)
    return (df.groupBy(*keys, period.alias("_period"))
              .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(date)).alias("_r"))
              .select("_r.*"))


def share_of_partition(df: DataFrame, keys: Sequence[str], value: str, out: str, scale: float = 100.0) -> DataFrame:
    """Value / sum(value) over the key * 100."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(w)) * F.lit(scale))

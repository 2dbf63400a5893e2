"""As-of (forward-fill) joins, the one relational shape Spark SQL lacks.

Three physical forms, chosen by the caller:

``step_intervals`` + ``explode_days`` / ``explode_month_ends``
    A sparse step series (one row per key and change date, already
    pre-aggregated) becomes validity intervals ``[at, valid_to]`` with one
    ``lead`` window, then is exploded onto the dates it covers. Two such
    dense frames meet in a plain equi-join on (key, date): hash partitioning
    on the composite key spreads a hot key over all its dates, so no task
    holds a whole key. This replaces "date spine + ASOF JOIN" with no range
    join and no spine table at all.

``asof_join(..., bucket=None)``
    Union of both sides and ``last(payload, ignorenulls)`` over a per-key
    window. Per-key work is bounded only when the key's rows are bounded
    (e.g. daily grain: at most one row per calendar day per side).

``asof_join(..., bucket=fn)``
    Skew-safe general form for unbounded per-key rows: the window runs per
    (key, time bucket); rows whose bucket holds no earlier right row take the
    last right row of the previous buckets, found by a second as-of at bucket
    grain (per key bounded by the number of buckets, not by the data).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_ends_between


def _lit_date(d) -> Column:
    return d if isinstance(d, Column) else F.lit(str(d)).cast("date")


def step_intervals(df: DataFrame, keys: Sequence[str], at: str, horizon,
                   valid_to: str = "valid_to") -> DataFrame:
    """Add ``valid_to`` = day before the key's next change date, else ``horizon``.

    Rows dated after the horizon are dropped first, so the last surviving row
    of a key stays valid through the horizon. ``df`` must have unique
    (keys, at) — pre-aggregate duplicates before calling.
    """
    h = _lit_date(horizon)
    w = Window.partitionBy(*keys).orderBy(at)
    return (df.filter(F.col(at) <= h)
              .withColumn(valid_to, F.coalesce(F.date_sub(F.lead(at).over(w), 1), h)))


def explode_days(df: DataFrame, start: str, end: str, out: str = "date") -> DataFrame:
    """One row per calendar day in [start, end] (C5: the date spine without a join)."""
    return df.withColumn(out, F.explode(F.sequence(F.col(start), F.col(end))))


def explode_month_ends(df: DataFrame, start: str, end: str, out: str = "date") -> DataFrame:
    """One row per calendar month end in [start, end]; about 30x fewer rows than days."""
    return df.withColumn(out, F.explode(month_ends_between(F.col(start), F.col(end))))


def forward_fill(df: DataFrame, keys: Sequence[str], at: str, horizon,
                 grain: str = "day", out: str = "date", min_value: tuple[str, float] | None = None,
                 window: tuple[str, str] | None = None) -> DataFrame:
    """Dense as-of series: each step value repeated on every day (or month end) it holds.

    ``min_value=(col, threshold)`` drops intervals whose value is not above the
    threshold before exploding, so closed positions never materialise.
    ``window=(first_day, last_day)`` clips every interval to that range before
    exploding: a report over one year of a 30-year history generates one
    year of rows (a filter on the generated date could not be pushed below
    the explode).
    """
    iv = step_intervals(df, keys, at, horizon, "_valid_to")
    if min_value is not None:
        iv = iv.filter(F.col(min_value[0]) > F.lit(min_value[1]))
    start = "_valid_from"
    iv = iv.withColumn(start, F.col(at))
    if window is not None:
        lo, hi = _lit_date(window[0]), _lit_date(window[1])
        iv = (iv.withColumn(start, F.greatest(F.col(at), lo))
                .withColumn("_valid_to", F.least(F.col("_valid_to"), hi))
                .filter(F.col(start) <= F.col("_valid_to")))
    exploded = (explode_days if grain == "day" else explode_month_ends)(iv, start, "_valid_to", out)
    return exploded.drop("_valid_to", start)


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
              payload: Sequence[str], how: str = "left",
              bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each left row, the latest right row with equal ``on`` keys and right_time <= left_time.

    ``how='left'`` keeps unmatched left rows with null payload, ``'inner'``
    drops them. The payload travels as one struct so that nulls inside a
    matched right row are carried, not skipped. Right rows must be unique per
    (on, right_time).
    """
    on = list(on)
    payload = list(payload)
    pay = F.struct(*[F.col(c) for c in payload]).alias("_pay")
    lcols = left.columns
    L = left.select(*[F.col(c) for c in lcols],
                    F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(
                        right.select(pay).schema[0].dataType).alias("_pay"))
    R = right.select(*[F.col(c) for c in on], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), pay)
    if bucket is None:
        U = L.unionByName(R, allowMissingColumns=True)
        w = (Window.partitionBy(*on).orderBy("_t", "_side")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        res = U.withColumn("_m", F.last("_pay", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    else:
        L = L.withColumn("_b", bucket(F.col("_t")))
        R = R.withColumn("_b", bucket(F.col("_t")))
        U = L.unionByName(R, allowMissingColumns=True)
        w = (Window.partitionBy(*on, "_b").orderBy("_t", "_side")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        inb = U.withColumn("_m", F.last("_pay", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
        # Latest right row per (key, bucket), then carried to later buckets
        # by an as-of at bucket grain: bounded by buckets per key.
        rb = R.groupBy(*on, "_b").agg(F.max_by("_pay", "_t").alias("_rb"))
        need = inb.filter(F.col("_m").isNull()).select(*on, "_b").distinct()
        # lookups sort before the right rows of their own bucket, so only
        # strictly earlier buckets can feed the carry
        bu = (need.select(*on, "_b", F.lit(0).alias("_side"), F.lit(None).cast(
                  rb.schema["_rb"].dataType).alias("_rb"))
              .unionByName(rb.select(*on, "_b", F.lit(1).alias("_side"), "_rb")))
        wb = (Window.partitionBy(*on).orderBy("_b", "_side")
              .rowsBetween(Window.unboundedPreceding, -1))
        carry = (bu.withColumn("_carry", F.last("_rb", ignorenulls=True).over(wb))
                   .filter(F.col("_side") == 0).select(*on, "_b", "_carry"))
        res = (inb.join(carry, on=[*on, "_b"], how="left")
                  .withColumn("_m", F.coalesce("_m", "_carry")))
    if how == "inner":
        res = res.filter(F.col("_m").isNotNull())
    return res.select(*[F.col(c) for c in lcols], *[F.col(f"_m.{c}").alias(c) for c in payload])

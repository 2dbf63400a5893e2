"""Modified Dietz returns and trailing metrics.

Portfolio, fund and benchmark returns share one code path: a previous-row
value (``lag``), a per-row return expression, then ``trailing_metrics`` over
one named window per entity.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.windows import lag_value, trailing_metrics
from ledgerline.plans.snapshots import Snapshots

RATIO_DIGITS = 6   # ratios are reported to 6 places (float noise sits far below)

TRAILING_COLS = ["trailing_12m_return", "trailing_36m_return_annualised",
                 "trailing_12m_sharpe", "trailing_36m_sharpe"]


def modified_dietz(emv: Column, bmv: Column, cf: Column) -> Column:
    """(EMV - BMV - CF) / (BMV + CF/2); null when the denominator is 0."""
    denom = bmv + F.lit(0.5) * cf
    return F.when(denom != 0, (emv - bmv - cf) / denom)


def ratio(c: Column) -> Column:
    return F.round(c, RATIO_DIGITS)


class Returns(Snapshots):
    def _dietz(self, snap: DataFrame, keys: list[str], emv: str, cf: str) -> DataFrame:
        df = lag_value(snap, keys, "year_month", emv, "bmv").filter(F.col("bmv").isNotNull())
        return df.withColumn("monthly_return", modified_dietz(F.col(emv), F.col("bmv"), F.col(cf)))

    @cached_property
    def portfolio_returns_monthly(self) -> DataFrame:       # I11 + I13
        df = self._dietz(self.portfolio_snapshot_monthly, ["account_name"], "month_end_value_gbp",
                         "monthly_inflows_gbp")
        df = trailing_metrics(df, ["account_name"], "year_month", "monthly_return")
        return df.select("account_name", "year_month", "financial_year", "month_end_date",
                         "month_end_value_gbp", F.col("bmv").alias("prev_month_end_value_gbp"),
                         F.col("monthly_inflows_gbp").alias("month_inflows_gbp"),
                         "monthly_return", *TRAILING_COLS)

    @cached_property
    def fund_returns_monthly(self) -> DataFrame:            # I12
        df = self._dietz(self.fund_snapshot_monthly, ["account_name", "fund_name"], "month_end_value_gbp",
                         "monthly_net_fund_flows_gbp")
        return df.select("account_name", "fund_name", "fund_short_name", "year_month", "financial_year",
                         "month_end_date", "month_end_value_gbp",
                         F.col("bmv").alias("prev_month_end_value_gbp"),
                         F.col("monthly_net_fund_flows_gbp").alias("month_net_flows_gbp"), "monthly_return")

    @cached_property
    def benchmark_returns_monthly(self) -> DataFrame:       # I14
        b = lag_value(self.fct_benchmarks_monthly, ["index_id"], "year_month", "month_end_level",
                      "prev_month_end_level")
        # The first month (no previous level) is dropped before the trailing
        # windows, so it never counts towards the 12/36-row gates.
        b = (b.filter(F.col("prev_month_end_level").isNotNull())
             .withColumn("monthly_return",
                         F.try_divide(F.col("month_end_level") - F.col("prev_month_end_level"),
                                      F.col("prev_month_end_level"))))
        b = trailing_metrics(b, ["index_id"], "year_month", "monthly_return")
        return (b
                .select("index_id", "ticker", "year_month", "month_end_date", "month_end_level",
                        "prev_month_end_level", "monthly_return", *TRAILING_COLS))

"""Derived series and reports.

Series helpers take long frames ``(series, date, value)`` and never pivot on
unbounded values: pivots list their columns explicitly. "First/last point"
and "last n points" are aggregates (``min_by``/``max_by``) or scalar
top-k subqueries, not global windows, so no step funnels a series into one
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import dround, exact_sum
from ledgerline.operators.windows import cumprod_index, period_end_downsample, rebase_to_first
from ledgerline.plans.adhoc import SECONDS, answer, check_statement
from ledgerline.plans.serving import Serving
from ledgerline.plans.star import FUND, HOLDING, money

DAYS_PER_YEAR = 365.25
CASH_FUND_ID = "CASH"
TAIL_POINTS = 23             # series longer than 24 points: first point + last 23
MAX_POINTS = 24


# -------------------------------------------------------------- series helpers
def series_endpoints(df: DataFrame, key: str = "series", date: str = "date", value: str = "value") -> DataFrame:
    """first and last point and the number of points per series."""
    return df.groupBy(key).agg(
        F.min(date).alias("start_date"), F.min_by(value, date).alias("start_value"),
        F.max(date).alias("end_date"), F.max_by(value, date).alias("end_value"),
        F.count(F.lit(1)).alias("points"))


def total_and_annualised(df: DataFrame, key: str = "series", date: str = "date", value: str = "indexed") -> DataFrame:
    """Total return (last - 100) and CAGR over days/365.25 years (null under one year)."""
    e = series_endpoints(df, key, date, value)
    years = F.datediff("end_date", "start_date") / F.lit(DAYS_PER_YEAR)
    return e.select(key, (F.col("end_value") - 100).alias("total_return_pct"),
                    F.when(years >= 1, (F.pow(F.col("end_value") / 100, 1 / years) - 1) * 100)
                    .alias("annualised_return_pct"))


def year_end_values(df: DataFrame, key: str = "series", date: str = "date", value: str = "indexed") -> DataFrame:
    return df.groupBy(key, F.year(date).alias("year")).agg(F.max_by(value, date).alias("year_end"))


def prior_year_end_ratio(df: DataFrame, key: str = "series", date: str = "date", value: str = "indexed") -> DataFrame:
    """(end of year / end of previous year - 1) * 100; null when the previous year has no point."""
    ye = year_end_values(df, key, date, value)
    prev = ye.select(key, (F.col("year") + 1).alias("year"), F.col("year_end").alias("prev_end"))
    return ye.join(prev, [key, "year"], "left").select(
        key, "year", F.when(F.col("prev_end").isNotNull(),
                            (F.try_divide(F.col("year_end"), F.col("prev_end")) - 1) * 100).alias("return_pct"))


def first_plus_last_n(df: DataFrame, date: str = "date", tail: int = TAIL_POINTS, max_points: int = MAX_POINTS) -> DataFrame:
    """a series of more than ``max_points`` points keeps its first point and its last ``tail``.

    The cut-off is the ``tail``-th latest date, a top-k scalar subquery
    (per-partition top-k, merged), so the series is never sorted in one task.
    """
    n = df.select(F.count(F.lit(1))).scalar()
    first = df.select(F.min(date)).scalar()
    cutoff = df.select(date).orderBy(F.col(date).desc()).limit(tail).select(F.min(date)).scalar()
    return df.filter((n <= max_points) | (F.col(date) == first) | (F.col(date) >= cutoff))


def align_series(df: DataFrame, series: list[str], key: str = "series", date: str = "date",
                 value: str = "indexed", require: list[str] | None = None) -> DataFrame:
    """One row per date in the union of the series' dates, a column per series (null if absent)."""
    wide = df.groupBy(date).pivot(key, series).agg(F.first(value))
    wide = wide.select(date, *[F.col(f"`{s}`").alias(f"s{i}") for i, s in enumerate(series)])
    if require:
        idx = [series.index(r) for r in require]
        cond = None
        for i in idx:
            c = F.col(f"s{i}").isNotNull()
            cond = c if cond is None else cond | c
        wide = wide.filter(cond)
    return wide


# Views that ad-hoc SQL may name, and their models.
VIEWS = {
    "mart_holdings_latest": "holdings_latest", "mart_portfolio_value_daily": "portfolio_value_daily",
    "mart_portfolio_inflows_daily": "portfolio_inflows_daily",
    "mart_portfolio_returns_monthly": "portfolio_returns_monthly",
    "mart_benchmarks_monthly": "benchmark_returns_monthly",
    "mart_contributions_by_financial_year": "contributions_by_fy",
    "mart_portfolio_snapshot_monthly": "portfolio_snapshot_monthly",
    "mart_fund_snapshot_monthly": "fund_snapshot_monthly", "mart_fund_returns_monthly": "fund_returns_monthly",
    "dim_account": "dim_account", "dim_fund": "dim_fund", "dim_date": "dim_date",
    "dim_transaction_type": "dim_transaction_type",
}


class Derived(Serving):
    # ------------------------------------------------------------ E10 + G3 + I34
    def rebased_comparison(self, account: str, rebase_month: str, index_ids: list[str]) -> DataFrame:
        """Account's chained Dietz returns vs index levels, both 100 at the month end before the rebase month."""
        r = self.portfolio_returns_monthly.filter(
            (F.col("account_name") == account) & (F.col("year_month") >= rebase_month))
        port = cumprod_index(r, ["account_name"], "year_month", "monthly_return", "value") \
            .select(F.lit(account).alias("series"), F.col("month_end_date").alias("date"),
                    F.when(F.col("monthly_return").isNotNull(), F.col("value")).alias("value"))
        b = self.benchmark_returns_monthly.filter(
            F.col("index_id").isin(*index_ids) & (F.col("year_month") >= rebase_month))
        bench = rebase_to_first(b, ["index_id"], "year_month", "month_end_level", "value") \
            .select(F.col("index_id").alias("series"), F.col("month_end_date").alias("date"), "value")
        start = F.date_sub(F.to_date(F.lit(rebase_month + "-01")), 1)
        base = (self.spark.createDataFrame([(s,) for s in [account, *index_ids]], "series string")
                .select("series", start.alias("date"), F.lit(100.0).alias("value")))
        return port.unionByName(bench).unionByName(base).select(
            "series", "date", F.round("value", 6).alias("value"))

    # ------------------------------------------------------------ E12 / F6 / I30
    def inflows_monthly(self, date_from: str, date_to: str) -> DataFrame:
        daily = self.inflows_vs_growth(date_from, date_to).withColumn("series", F.lit("all"))
        return period_end_downsample(daily, ["series"], "date").drop("series")

    def period_growth(self, date_from: str, date_to: str, account: str | None = None) -> DataFrame:
        """Inflows added and growth (change in value minus inflows) between first and last point."""
        d = self.inflows_vs_growth(date_from, date_to, account)
        e = d.agg(F.min_by("portfolio_value", "date").alias("v0"), F.max_by("portfolio_value", "date").alias("v1"),
                  F.min_by("cumulative_inflows", "date").alias("c0"), F.max_by("cumulative_inflows", "date").alias("c1"))
        return e.select(money(F.col("c1") - F.col("c0")).alias("period_inflows"),
                        money((F.col("v1") - F.col("v0")) - (F.col("c1") - F.col("c0"))).alias("period_growth"))

    # ------------------------------------------------------------ I29
    def calendar_year_returns(self, date_from: str, date_to: str, index_ids: list[str]) -> DataFrame:
        s = self.performance_series(date_from, date_to, None, index_ids)
        ratios = prior_year_end_ratio(s)
        names = ["portfolio", *index_ids]
        wide = ratios.groupBy("year").pivot("series", names).agg(F.first("return_pct"))
        cols = [F.round(F.col(f"`{n}`"), 6).alias(f"r{i}") for i, n in enumerate(names)]
        out = wide.select("year", (F.col("year") == F.year(F.lit(date_to).cast("date"))).alias("is_ytd"), *cols)
        any_value = None
        for i in range(len(names)):
            c = F.col(f"r{i}").isNotNull()
            any_value = c if any_value is None else any_value | c
        return out.filter(any_value).orderBy(F.col("year").desc())

    # ------------------------------------------------------------ I31 / C15
    def monthly_summary(self) -> DataFrame:
        """Account rows at the latest snapshot month end (returns left-joined) plus a TOTAL Dietz row."""
        s = self.portfolio_snapshot_monthly
        last = s.select(F.max("month_end_date")).scalar()
        r = self.portfolio_returns_monthly.select("account_name", "year_month", "prev_month_end_value_gbp",
                                                  "monthly_return")
        acc = (s.filter(F.col("month_end_date") == last).join(r, ["account_name", "year_month"], "left")
               .select("account_name", "month_end_date", "month_end_value_gbp", "prev_month_end_value_gbp",
                       "monthly_inflows_gbp", F.round("monthly_return", 6).alias("monthly_return")))
        tv, ti = exact_sum("month_end_value_gbp"), exact_sum("monthly_inflows_gbp")
        tb = exact_sum("prev_month_end_value_gbp")
        bmv = F.when(tb != 0, tb)            # no or zero prior value -> no total return
        total = acc.agg(
            F.lit("TOTAL").alias("account_name"), F.max("month_end_date").alias("month_end_date"),
            money(tv).alias("month_end_value_gbp"), money(bmv).alias("prev_month_end_value_gbp"),
            money(ti).alias("monthly_inflows_gbp"),
            F.round(F.when(bmv.isNotNull() & ((bmv + 0.5 * ti) != 0), (tv - bmv - ti) / (bmv + 0.5 * ti)), 6)
            .alias("monthly_return"))
        return acc.unionByName(total)

    def fund_summary(self) -> DataFrame:
        """Fund rows at the latest fund month end; first-month funds kept without a return."""
        s = self.fund_snapshot_monthly
        last = s.select(F.max("month_end_date")).scalar()
        r = self.fund_returns_monthly.select("account_name", "fund_name", "year_month", "monthly_return")
        return (s.filter(F.col("month_end_date") == last)
                .join(r, ["account_name", "fund_name", "year_month"], "left")
                .select("account_name", "fund_name", "fund_short_name", "month_end_value_gbp",
                        F.round("monthly_return", 6).alias("monthly_return")))

    # ------------------------------------------------------------ I32
    def fy_end_return_table(self, accounts: list[str]) -> DataFrame:
        """March rows of trailing returns, one column per (account, metric), percent to 1 place."""
        r = self.portfolio_returns_monthly.filter(
            (F.month("month_end_date") == 3) & F.col("account_name").isin(*accounts))
        aggs = []
        for i, a in enumerate(accounts):
            for m, col in (("1yr", "trailing_12m_return"), ("3yr_pa", "trailing_36m_return_annualised")):
                aggs.append(dround(F.max(F.when(F.col("account_name") == a, F.col(col))) * 100, 1)
                            .alias(f"a{i}_{m}"))
        return r.groupBy(F.date_format("month_end_date", "'Mar-'yy").alias("fy_end"),
                         F.col("month_end_date").alias("fy_end_date")).agg(*aggs)

    # ------------------------------------------------------------ I33 / C13
    def fund_values_between(self, d0: str, d1: str) -> DataFrame:
        """Daily fund values for [d0, d1] only: intervals are clipped before exploding."""
        return self._fund_values("day", (d0, d1))

    def fund_value_history(self, cutoff: str, d0: str, d1: str, min_value: float = 1.0) -> DataFrame:
        """Daily value per fund in [d0, d1] for the funds held above ``min_value`` on the cut-off day."""
        opened = self.dim_account.select(F.min("account_open_date")).scalar()
        day = F.when(opened <= F.lit(cutoff).cast("date"),
                     F.least(F.lit(cutoff).cast("date"), F.lit(self.horizon).cast("date")))
        held = (self.positions_at(day).filter((F.col("holding_type") == FUND) & (F.col("value_gbp") > min_value))
                .select("fund_key").distinct())
        v = self.fund_values_between(d0, d1).join(held, "fund_key", "left_semi")
        names = self.dim_fund.select("fund_key", "fund_name")
        return (v.join(names, "fund_key").groupBy("date", "fund_name")
                .agg(money(exact_sum("value_gbp")).alias("value_gbp")))

    # ------------------------------------------------------------ B9 / B11
    def list_funds(self, active_only: bool = False) -> DataFrame:
        f = self.dim_fund.filter(F.col("fund_id") != CASH_FUND_ID).select(
            "fund_id", "fund_name", "fund_short_name", "morningstar_code", "first_investment_date",
            "investment_status_indicator",
            (F.col("investment_status_indicator") == HOLDING).alias("is_active"))
        if active_only:
            f = f.filter(F.col("is_active"))
        return f.orderBy("fund_name")

    def register_views(self, names=None) -> None:
        """Marts and dimensions (or the named ones) as temp views, the only tables ad-hoc SQL can name."""
        for name in VIEWS if names is None else names:
            getattr(self, VIEWS[name]).createOrReplaceTempView(name)

    def adhoc_select(self, sql: str, seconds: float = SECONDS) -> DataFrame:
        """The first 200 rows of a read-only SELECT over the mart and dimension views, within ``seconds``.

        The limit covers the statement, not the checks in front of it; a statement that takes longer is cancelled.
        """
        self.register_views(check_statement(self.spark, sql, VIEWS))
        return answer(self.spark.sql(sql), seconds)

"""Serving marts and API-shaped reports.

Point-in-time positions (``positions_at``) are read straight off the sparse
validity intervals: "units on day d" is the interval containing d, "price on
day d" is the last price dated <= d. So "latest holdings" and "allocation as
of" never explode the dense daily table. Scalar lookups ("latest fund date",
"grand total") are scalar subqueries (``DataFrame.scalar()``): a partial
aggregate per partition and one tiny final row, never a cross join and never
a single-partition window over the data.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import dates as D
from ledgerline.functions.numeric import FINE_TYPE, exact_sum, exact_sum_over
from ledgerline.operators.asof import asof_join, step_intervals
from ledgerline.operators.windows import running_sum
from ledgerline.plans.returns import Returns
from ledgerline.plans.star import (BUY_SIDE, CASH, FUND, INFLOW_TYPES, OPEN_UNITS, SELL_SIDE, SHOWN_UNITS,
                                   money)

INDEX_SCALE = 100.0
INDEX_DIGITS = 4


class Serving(Returns):
    # ---------------------------------------------------------------- positions
    @cached_property
    def unit_intervals(self) -> DataFrame:
        """Open-position intervals [u0, u1] per (account, fund) with the fund's first price date."""
        iv = step_intervals(self.unit_steps, ["account_key", "fund_key"], "trade_date", self.horizon, "u1") \
            .filter(F.col("units_held") > OPEN_UNITS).withColumnRenamed("trade_date", "u0")
        first_price = (self.price_steps.filter(F.col("price_date") <= F.lit(self.horizon).cast("date"))
                       .groupBy("fund_key").agg(F.min("price_date").alias("fp")))
        return iv.join(first_price, "fund_key")

    def latest_fund_day(self, cap=None) -> Column:
        """Last day <= cap on which any fund row exists (C10/C11), as a date literal.

        Resolved once by a one-row aggregate (a bounded scalar, not data) so that
        every filter that uses it is a literal comparison Spark can push down to the
        parquet scans, instead of a scalar subquery repeated in each of them.
        """
        hi = F.col("u1") if cap is None else F.least(F.col("u1"), F.lit(cap).cast("date"))
        iv = self.unit_intervals
        day = iv.filter(F.greatest("u0", "fp") <= hi).agg(F.max(hi).alias("d")).first()["d"]
        return F.lit(day).cast("date")

    def prices_at(self, day: Column) -> DataFrame:
        return (self.price_steps.filter(F.col("price_date") <= day)
                .groupBy("fund_key").agg(F.max_by("fund_price_gbp", "price_date").alias("fund_price_gbp")))

    def positions_at(self, day: Column) -> DataFrame:
        """Fund and cash rows of ``holdings_daily`` on one day, from the sparse steps."""
        iv = self.unit_intervals.filter((F.col("u0") <= day) & (day <= F.col("u1")) & (F.col("fp") <= day))
        funds = (iv.join(self.prices_at(day), "fund_key")
                 .select("account_key", "account_name", "fund_key", "fund_id", F.lit(FUND).alias("holding_type"),
                         "units_held", "fund_price_gbp",
                         (F.col("units_held") * F.col("fund_price_gbp")).alias("value_gbp")))
        cash = (self.cash_steps.filter(F.col("trade_date") <= day)
                .groupBy("account_key", "account_name")
                .agg(F.max_by("cash_balance_gbp", "trade_date").alias("value_gbp"))
                .select("account_key", "account_name", F.lit(None).cast("string").alias("fund_key"),
                        F.lit(None).cast("string").alias("fund_id"), F.lit(CASH).alias("holding_type"),
                        F.lit(None).cast("double").alias("units_held"),
                        F.lit(None).cast("double").alias("fund_price_gbp"), "value_gbp"))
        return funds.unionByName(cash).withColumn("valuation_date", day)

    def values_at(self, day: str) -> DataFrame:
        """I6 on one day, from the sparse steps: accounts worth more than nothing."""
        return (self.positions_at(F.lit(day).cast("date")).groupBy("account_name")
                .agg(F.lit(day).cast("date").alias("valuation_date"), money(exact_sum("value_gbp")).alias("portfolio_value_gbp"))
                .filter(F.col("portfolio_value_gbp") > 0))

    def last_value_day(self, upto: str) -> str:
        """Last day up to ``upto`` on which some account is worth more than nothing.

        That is nearly always ``upto`` itself, which one point-in-time read tells; else months are looked at backwards.
        """
        day = min(upto, self.horizon)
        if self.values_at(day).limit(1).count():
            return day
        last = _dt.date.fromisoformat(day)
        while last >= _dt.date.fromisoformat(self.cal_start):
            first = last.replace(day=1)
            found = self._value_by_day(self._holdings("day", (f"{first}", f"{last}"))).agg(F.max("valuation_date")).first()[0]
            if found is not None:
                return f"{found}"
            last = first - _dt.timedelta(days=1)
        return day

    # ------------------------------------------------------------ cost basis
    @cached_property
    def cost_basis(self) -> DataFrame:
        t = self.fct_transactions_wide.filter(
            F.col("fund_key").isNotNull() & (F.col("quantity") > 0)
            & F.col("transaction_type").isin(*BUY_SIDE, *SELL_SIDE))
        ty, v = F.col("transaction_type"), F.abs(F.col("value_gbp"))
        return (t.groupBy("account_key", "fund_key")
                .agg(exact_sum(F.when(ty.isin(*BUY_SIDE), v)).alias("total_cost_gbp"),
                     exact_sum(F.when(ty.isin(*SELL_SIDE), v)).alias("total_proceeds_gbp")))

    # --------------------------------------------------------------- I7
    @cached_property
    def holdings_latest(self) -> DataFrame:
        day = self.latest_fund_day()
        pos = self.positions_at(day).filter((F.col("holding_type") == CASH) | (F.col("units_held") >= SHOWN_UNITS))
        funds = self.dim_fund.select("fund_key", "fund_name")
        is_cash = F.col("holding_type") == CASH
        cost = F.when(is_cash, F.lit(None).cast("double")).otherwise(
            F.greatest(F.coalesce("total_cost_gbp", F.lit(0.0)) - F.coalesce("total_proceeds_gbp", F.lit(0.0)),
                       F.lit(0.0)))
        v = (pos.join(funds, "fund_key", "left")
             .join(self.cost_basis, ["account_key", "fund_key"], "left")
             .withColumn("cost", cost))
        gain = F.col("value_gbp") - F.col("cost")
        return v.select(
            "account_name", "holding_type", "fund_name", "valuation_date", "units_held",
            F.round("fund_price_gbp", 4).alias("fund_price_gbp"),
            money(F.col("value_gbp")).alias("value_gbp"),
            money(F.col("cost")).alias("cost_basis_gbp"),
            F.when(~is_cash, money(gain)).alias("unrealised_gain_gbp"),
            F.when(is_cash, F.lit(None).cast("double"))
             .when(F.col("cost") > 0, F.round(gain / F.col("cost") * 100.0, 2))
             .otherwise(F.lit(0.0)).alias("unrealised_gain_pct"),
            F.round(F.try_divide(F.col("value_gbp"), exact_sum_over("value_gbp", Window.partitionBy("account_name")))
                    * 100.0, 2).alias("weight_pct"))

    # --------------------------------------------------------------- I8
    @cached_property
    def daily_inflows(self) -> DataFrame:
        t = self.fct_transactions_wide.filter(
            F.col("account_key").isNotNull() & F.col("transaction_type").isin(*INFLOW_TYPES))
        d = t.groupBy("account_name", F.col("trade_date").alias("inflow_date")).agg(
            exact_sum("value_gbp").alias("inflow_today"))
        return running_sum(d, ["account_name"], "inflow_date", "inflow_today", "cumulative_inflows_gbp")

    @cached_property
    def portfolio_inflows_daily(self) -> DataFrame:
        return self._inflows_for(self.portfolio_value_daily)

    def portfolio_inflows_between(self, d0: str, d1: str) -> DataFrame:
        """I8 restricted to [d0, d1]: only in-range days are generated; the
        cumulative inflows still come from the full (sparse) inflow history."""
        if "portfolio_inflows_daily" in self.materialised:
            return self.portfolio_inflows_daily.filter(F.col("valuation_date").between(
                F.lit(d0).cast("date"), F.lit(d1).cast("date")))
        return self._inflows_for(self.portfolio_value_between(d0, d1))

    def _inflows_for(self, pv: DataFrame) -> DataFrame:
        di = self.daily_inflows
        # daily grain on both sides: per account at most one row per day each,
        # so the per-account as-of window is bounded by the calendar.
        j = asof_join(pv, di, ["account_name"], "valuation_date", "inflow_date",
                      ["inflow_date", "inflow_today", "cumulative_inflows_gbp"], how="left")
        today = F.when(F.col("inflow_date") == F.col("valuation_date"), F.col("inflow_today"))
        return j.select("account_name", "valuation_date", "portfolio_value_gbp",
                        money(F.coalesce(today, F.lit(0.0))).alias("inflows_gbp"),
                        money(F.coalesce("cumulative_inflows_gbp", F.lit(0.0))).alias("cumulative_inflows_gbp"))

    # --------------------------------------------------------------- I15
    @cached_property
    def contributions_by_fy(self) -> DataFrame:
        t = self.fct_transactions_wide.filter(
            F.col("account_key").isNotNull() & (F.col("transaction_type") == "CONTRIBUTION"))
        return (t.groupBy("account_name", D.financial_year(F.col("trade_date")).alias("financial_year"))
                .agg(money(exact_sum("value_gbp")).alias("contributions_gbp")))

    # --------------------------------------------------------------- I16
    def portfolio_value_series(self, date_from: str, date_to: str, account: str | None = None) -> DataFrame:
        pv = self.portfolio_value_between(date_from, date_to)
        if account is not None:
            pv = pv.filter(F.col("account_name") == account)
        return pv.groupBy(F.col("valuation_date").alias("date")).agg(
            money(exact_sum("portfolio_value_gbp")).alias("value_gbp"))

    # --------------------------------------------------------------- I17
    def allocation_as_of(self, as_of: str | None = None, account: str | None = None) -> DataFrame:
        day = self.latest_fund_day(as_of)
        pos = self.positions_at(day).filter((F.col("holding_type") == FUND) & (F.col("units_held") >= SHOWN_UNITS))
        if account is not None:
            pos = pos.filter(F.col("account_name") == account)
        funds = self.dim_fund.select("fund_key", "fund_name", "fund_short_name")
        per_fund = (pos.join(funds, "fund_key")
                    .groupBy("fund_id", "fund_name", "fund_short_name")
                    .agg(exact_sum("units_held").alias("units_held"), F.max("fund_price_gbp").alias("price_gbp"),
                         money(exact_sum("value_gbp")).alias("value_gbp")))
        total = per_fund.select(exact_sum("value_gbp")).scalar()          # D12, two-step total
        return per_fund.select(
            "fund_id", "fund_name", F.coalesce("fund_short_name", "fund_name").alias("fund_short_name"),
            "units_held", "price_gbp", "value_gbp",
            F.round(F.try_divide(F.col("value_gbp"), total) * 100.0, 2).alias("percentage"))

    # --------------------------------------------------------------- I18
    def inflows_vs_growth(self, date_from: str, date_to: str, account: str | None = None) -> DataFrame:
        d = self.portfolio_inflows_between(date_from, date_to)
        if account is not None:
            d = d.filter(F.col("account_name") == account)
        g = d.groupBy(F.col("valuation_date").alias("date")).agg(
            money(exact_sum("portfolio_value_gbp")).alias("portfolio_value"),
            money(exact_sum("cumulative_inflows_gbp")).alias("cumulative_inflows"))
        return g.withColumn("growth", money(F.col("portfolio_value") - F.col("cumulative_inflows")))

    # --------------------------------------------------------------- I19
    def contributions_fy_pivot(self, accounts: list[str]) -> DataFrame:
        c = self.contributions_by_fy
        cols = [money(exact_sum(F.when(F.col("account_name") == a, F.col("contributions_gbp")).otherwise(0.0)))
                .alias(f"{a.lower()}_gbp") for a in accounts]
        return c.groupBy("financial_year").agg(*cols, money(exact_sum("contributions_gbp")).alias("total_gbp"))

    # --------------------------------------------------------------- I20
    def weighted_monthly_return(self, date_from: str, date_to: str, account: str | None = None) -> DataFrame:
        """Cross-account return weighted by BMV + CF/2 (0 when the weights sum to 0)."""
        r = self.portfolio_returns_monthly.filter(F.col("month_end_date").between(
            F.lit(date_from).cast("date"), F.lit(date_to).cast("date")))
        if account is not None:
            r = r.filter(F.col("account_name") == account)
        w = F.col("prev_month_end_value_gbp") + F.lit(0.5) * F.col("month_inflows_gbp")
        return (r.groupBy("month_end_date")
                .agg(exact_sum(F.col("monthly_return") * w, FINE_TYPE).alias("_num"), exact_sum(w, FINE_TYPE).alias("_den"))
                .select("month_end_date",
                        F.when(F.col("_den") == 0, F.lit(0.0)).otherwise(F.col("_num") / F.col("_den"))
                        .alias("monthly_return")))

    def performance_index(self, date_from: str, date_to: str, account: str | None = None) -> DataFrame:
        """Index 100 at the first month, then round(idx * (1 + r), 4) per month; null r carries.

        The stepwise rounding makes this an ordered fold. It runs as one
        ``aggregate`` over the month-sorted array of one series: the array
        holds one element per calendar month in range (bounded by the
        calendar, not by the data) and the monthly returns were already
        aggregated across accounts by the shuffle above.
        """
        m = self.weighted_monthly_return(date_from, date_to, account)
        arr = (m.groupBy(F.lit(1).alias("_series"))
               .agg(F.array_sort(F.collect_list(F.struct("month_end_date", "monthly_return"))).alias("pts")))
        init = F.struct(F.lit(None).cast("double").alias("idx"),
                        F.array().cast("array<struct<d:date,v:double>>").alias("out"))

        def step(acc, x):
            nxt = F.when(acc["idx"].isNull(), F.lit(INDEX_SCALE)) \
                   .when(x["monthly_return"].isNull(), acc["idx"]) \
                   .otherwise(F.round(acc["idx"] * (F.lit(1.0) + x["monthly_return"]), INDEX_DIGITS))
            return F.struct(nxt.alias("idx"),
                            F.array_append(acc["out"], F.struct(x["month_end_date"].alias("d"), nxt.alias("v")))
                            .alias("out"))
        folded = arr.select(F.explode(F.aggregate("pts", init, step)["out"]).alias("p"))
        return folded.select(F.col("p.d").alias("date"), F.col("p.v").alias("indexed"))

    # --------------------------------------------------------------- I21
    def benchmark_index(self, start: str, date_to: str, index_ids: list[str] | None = None) -> DataFrame:
        b = self.benchmark_returns_monthly.filter(F.col("month_end_date").between(
            F.lit(start).cast("date"), F.lit(date_to).cast("date")))
        if index_ids is not None:
            b = b.filter(F.col("index_id").isin(*index_ids))
        w = Window.partitionBy("index_id").orderBy("month_end_date") \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        base = F.first("month_end_level").over(w)
        return b.select(F.col("index_id").alias("series"), F.col("month_end_date").alias("date"),
                        F.round(F.try_divide(F.col("month_end_level"), base) * INDEX_SCALE, INDEX_DIGITS)
                        .alias("indexed"))

    def performance_start(self, date_from: str, date_to: str, account: str | None = None) -> Column:
        """Scalar: first month of the portfolio series, else ``date_from``."""
        m = self.weighted_monthly_return(date_from, date_to, account)
        return F.coalesce(m.select(F.min("month_end_date")).scalar(), F.lit(date_from).cast("date"))

    def performance_series(self, date_from: str, date_to: str, account: str | None = None,
                           index_ids: list[str] | None = None) -> DataFrame:
        """Long (series, date, indexed): the portfolio plus benchmarks rebased at its start."""
        port = self.performance_index(date_from, date_to, account).select(
            F.lit("portfolio").alias("series"), "date", "indexed")
        start = self.performance_start(date_from, date_to, account)
        b = self.benchmark_returns_monthly.filter(
            (F.col("month_end_date") >= start) & (F.col("month_end_date") <= F.lit(date_to).cast("date")))
        if index_ids is not None:
            b = b.filter(F.col("index_id").isin(*index_ids))
        w = Window.partitionBy("index_id").orderBy("month_end_date") \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bench = b.select(F.col("index_id").alias("series"), F.col("month_end_date").alias("date"),
                         F.round(F.try_divide(F.col("month_end_level"), F.first("month_end_level").over(w))
                                 * INDEX_SCALE, INDEX_DIGITS).alias("indexed"))
        return port.unionByName(bench)

    # --------------------------------------------------------------- I22
    def latest_sharpe(self, date_to: str, account: str | None = None) -> DataFrame:
        pr = self.portfolio_returns_monthly
        last_me = pr.filter(F.col("month_end_date") <= F.lit(date_to).cast("date")) \
            .select(F.max("month_end_date")).scalar()
        cur = pr.filter(F.col("month_end_date") == last_me)
        if account is not None:
            cur = cur.filter(F.col("account_name") == account)
        bmv = F.col("prev_month_end_value_gbp")

        def wavg(s):
            return F.try_divide(exact_sum(F.col(s) * bmv, FINE_TYPE),
                                F.nullif(exact_sum(F.when(F.col(s).isNotNull(), bmv), FINE_TYPE), F.lit(0.0)))
        port = cur.agg(wavg("trailing_12m_sharpe").alias("trailing_12m"),
                       wavg("trailing_36m_sharpe").alias("trailing_36m")) \
            .select(F.lit("portfolio").alias("series"), "trailing_12m", "trailing_36m")
        br = self.benchmark_returns_monthly
        last_ym = br.filter(F.col("month_end_date") <= F.lit(date_to).cast("date")) \
            .select(F.max("year_month")).scalar()
        bench = br.filter(F.col("year_month") == last_ym).select(
            F.col("index_id").alias("series"), F.col("trailing_12m_sharpe").alias("trailing_12m"),
            F.col("trailing_36m_sharpe").alias("trailing_36m"))
        return port.unionByName(bench)

    # --------------------------------------------------------------- I23
    @cached_property
    def holdings_combined(self) -> DataFrame:
        return self.combined_holdings()

    def combined_holdings(self, account: str | None = None) -> DataFrame:
        """Latest holdings pooled over accounts, or of one account; percentages are of the total shown."""
        h = self.holdings_latest
        if account is not None:
            h = h.filter(F.col("account_name") == account)
        f = self.dim_fund.select("fund_id", F.col("fund_name").alias("_fn"), "fund_short_name")
        cash_label = F.concat(F.col("account_name"), F.lit(" Cash"))
        j = h.join(f, h.fund_name == f._fn, "left")
        g = (j.groupBy("holding_type", "fund_id",
                       F.coalesce("fund_name", cash_label).alias("fund_name"),
                       F.coalesce("fund_short_name", cash_label).alias("fund_short_name"))
             .agg(exact_sum("units_held").alias("units_held"), F.max("fund_price_gbp").alias("price_gbp"),
                  money(exact_sum("value_gbp")).alias("value_gbp"), money(exact_sum("cost_basis_gbp")).alias("cost_basis_gbp"),
                  money(exact_sum("unrealised_gain_gbp")).alias("unrealised_gain_gbp")))
        pct = F.when(F.col("holding_type") == CASH, F.lit(None).cast("double")) \
            .when(F.col("cost_basis_gbp") > 0,
                  F.round((F.col("value_gbp") - F.col("cost_basis_gbp")) / F.col("cost_basis_gbp") * 100.0, 2)) \
            .otherwise(F.lit(0.0))
        total = g.select(exact_sum("value_gbp")).scalar()
        return g.select(F.lower("holding_type").alias("holding_type"), "fund_id", "fund_name", "fund_short_name",
                        F.round("units_held", 4).alias("units_held"), F.round("price_gbp", 4).alias("price_gbp"),
                        "value_gbp", "cost_basis_gbp", "unrealised_gain_gbp", pct.alias("unrealised_gain_pct"),
                        F.when(total > 0, F.round(F.col("value_gbp") / total * 100.0, 2)).otherwise(F.lit(0.0))
                        .alias("percentage"))

    # --------------------------------------------------------------- I24
    def fund_performance(self, fund_id: str, date_from: str | None, date_to: str,
                         index_ids: list[str] | None = None) -> DataFrame:
        """Month-end fund price rebased to 100 from the start date, with benchmarks overlaid.

        An unknown fund gives an empty frame (the API answers "not found").
        """
        fund = self.dim_fund.filter(F.col("fund_id") == fund_id)
        start = (F.lit(date_from).cast("date") if date_from is not None else
                 F.coalesce(fund.select(F.max("first_investment_date")).scalar(), F.lit("1995-01-01").cast("date")))
        if "holdings_month_end" in self.materialised:       # a written table: the filters reach its scan
            fv = self.holdings_month_end.filter((F.col("holding_type") == FUND) & (F.col("fund_id") == fund_id))
        else:                                               # one fund's steps only reach the window functions
            fv = self._fund_values("month", fund_id=fund_id)
        fv = fv.filter((F.col("date") >= start) & (F.col("date") <= F.lit(date_to).cast("date")))
        pts = fv.select("date", "fund_price_gbp").distinct().filter(F.col("fund_price_gbp") > 0)
        base = fv.select(F.min_by("fund_price_gbp", "date")).scalar()
        fund_series = pts.select(F.lit(fund_id).alias("series"), "date",
                                 F.round(F.try_divide(F.col("fund_price_gbp"), base) * INDEX_SCALE, INDEX_DIGITS)
                                 .alias("indexed"))
        b = self.benchmark_returns_monthly.filter(
            (F.col("month_end_date") >= start) & (F.col("month_end_date") <= F.lit(date_to).cast("date")))
        if index_ids is not None:
            b = b.filter(F.col("index_id").isin(*index_ids))
        w = Window.partitionBy("index_id").orderBy("month_end_date") \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bench = b.select(F.col("index_id").alias("series"), F.col("month_end_date").alias("date"),
                         F.round(F.try_divide(F.col("month_end_level"), F.first("month_end_level").over(w))
                                 * INDEX_SCALE, INDEX_DIGITS).alias("indexed"))
        # benchmarks only accompany an existing fund with at least one point
        has_fund = fv.select(F.count(F.lit(1))).scalar() > 0
        return fund_series.unionByName(bench.filter(has_fund))

    # --------------------------------------------------------------- I25 / F1
    @cached_property
    def transaction_log_rows(self) -> DataFrame:
        t = self.fct_transactions_wide.filter(F.col("account_key").isNotNull())
        f = self.dim_fund.select("fund_key", F.col("fund_id").alias("_fid"), "fund_name", "fund_short_name")
        return t.join(f, "fund_key", "left").select(
            F.col("transaction_id").alias("id"), F.col("account_name").alias("account_id"),
            F.col("_fid").alias("fund_id"), "fund_name", "fund_short_name", "trade_date",
            F.when(F.col("settle_date_key").isNotNull(), F.col("settle_date")).alias("settle_date"),
            F.col("transaction_reference").alias("reference"), "transaction_type", "transaction_subtype",
            F.lit(None).cast("double").alias("unit_cost_pence"), "quantity", "value_gbp")

    def transaction_filter(self, account: str | None = None, fund_id: str | None = None,
                           tx_type: str | None = None, date_from: str | None = None,
                           date_to: str | None = None) -> DataFrame:
        """Each filter applied only when given; an unknown type is ignored."""
        from ledgerline.plans.star import ALL_TYPES
        df = self.transaction_log_rows
        if account:
            df = df.filter(F.col("account_id") == account)
        if fund_id:
            df = df.filter(F.col("fund_id") == fund_id)
        if tx_type and tx_type.upper() in ALL_TYPES:
            df = df.filter(F.col("transaction_type") == tx_type.upper())
        if date_from:
            df = df.filter(F.col("trade_date") >= F.lit(date_from).cast("date"))
        if date_to:
            df = df.filter(F.col("trade_date") <= F.lit(date_to).cast("date"))
        return df

    def transaction_page(self, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
        """newest first, then id; LIMIT per_page OFFSET (page-1)*per_page, 1 <= per_page <= 200."""
        if page < 1 or not 1 <= per_page <= 200:
            raise ValueError("page >= 1 and 1 <= per_page <= 200")
        df = self.transaction_filter(**filters)
        return df.orderBy(F.col("trade_date").desc(), F.col("id").asc()).offset((page - 1) * per_page).limit(per_page)

    def transaction_page_after(self, cursor_date: str, cursor_id: str, per_page: int = 50, **filters) -> DataFrame:
        """Keyset page: rows after (date, id) in page order, so deep pages cost a filter, not an offset."""
        df = self.transaction_filter(**filters)
        d = F.lit(cursor_date).cast("date")
        after = (F.col("trade_date") < d) | ((F.col("trade_date") == d) & (F.col("id") > F.lit(cursor_id)))
        return df.filter(after).orderBy(F.col("trade_date").desc(), F.col("id").asc()).limit(per_page)

    # --------------------------------------------------------------- I26 / I27
    @cached_property
    def data_freshness(self) -> DataFrame:
        log = self.raw.ingest_log.filter((F.col("status") == "success") & (F.col("rows_inserted") > 0))
        return log.agg(F.max(F.when(F.col("source") == "transactions", F.col("run_at"))).alias("transaction_date"),
                       F.max(F.when(F.col("source") == "prices", F.col("run_at"))).alias("price_date"))

    @cached_property
    def ingest_log_summary(self) -> DataFrame:
        log = self.raw.ingest_log.filter(F.col("source").isin("transactions", "prices"))
        ok = F.col("status") == "success"
        stats = log.groupBy("source").agg(
            F.max(F.when(ok, F.col("run_at"))).alias("last_successful_at"),
            F.max(F.when(ok & (F.col("rows_inserted") > 0), F.col("run_at"))).alias("last_rows_imported_at"))
        latest = (self.raw.transactions.select(F.lit("transactions").alias("source"),
                                               F.col("trade_date").alias("d"))
                  .unionByName(self.raw.prices.select(F.lit("prices").alias("source"), F.col("date").alias("d")))
                  .groupBy("source").agg(F.max("d").alias("latest_data_date")))
        return stats.join(latest, "source", "left").select("source", "latest_data_date", "last_successful_at",
                                                           "last_rows_imported_at")

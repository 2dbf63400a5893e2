"""Dense periodic snapshots: units, fund values, cash, holdings, portfolio value,
monthly account and fund snapshots (I2-I6, I9, I10, G1, C5, C6, C8, C9).

Each dense series is built twice from the same sparse steps: at daily grain
(``*_daily``, the reference's tables) and at month-end grain (``*_month_end``),
which the monthly marts use. The month-end form explodes only calendar month
ends inside each validity interval (about 30x fewer rows), so no monthly
model ever touches a daily row.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import dates as D
from ledgerline.functions.numeric import MONEY_TYPE, exact_sum
from ledgerline.functions.keys import surrogate_key
from ledgerline.operators.asof import forward_fill
from ledgerline.operators.sizing import broadcast_if_small
from ledgerline.operators.windows import running_sum
from ledgerline.plans.star import (BUY_SIDE, CASH, FUND, INFLOW_TYPES, OPEN_UNITS, SELL_SIDE, Warehouse,
                                   money, signed_units)


class Snapshots(Warehouse):
    @property
    def horizon(self) -> str:
        """Last day of every dense series: the as-of date, within the calendar."""
        return min(self.as_of, self.cal_end)

    # ---- sparse steps ------------------------------------------------------
    @cached_property
    def unit_steps(self) -> DataFrame:
        """Cumulative units per (account, fund) on each trade date (D2 -> E1)."""
        t = self.fct_transactions_wide.filter(
            F.col("is_trade") & F.col("fund_key").isNotNull() & F.col("account_key").isNotNull())
        deltas = (t.groupBy("account_key", "account_name", "fund_key", "fund_id", "trade_date")
                  .agg(exact_sum(signed_units()).alias("unit_delta")))
        return running_sum(deltas, ["account_key", "fund_key"], "trade_date", "unit_delta", "units_held")

    @cached_property
    def price_steps(self) -> DataFrame:
        return self.fct_fund_prices_daily.select("fund_key", "price_date", "fund_price_gbp")

    @cached_property
    def cash_steps(self) -> DataFrame:
        """Running cash balance per account on each movement date, plus a zero
        balance on the opening date when the account opened before its first
        in-calendar movement (the left as-of's coalesce-to-0)."""
        return self._last_balance(self._cash_moves(), ["account_key", "account_name"])

    @staticmethod
    def _last_balance(moves: DataFrame, account: list[str]) -> DataFrame:
        return moves.groupBy(*account, "trade_date").agg(F.max_by("cash_balance_gbp", "_prio").alias("cash_balance_gbp"))

    def _cash_moves(self) -> DataFrame:
        moves = self.fct_cash_position_daily.select(
            "account_key", "account_name", "trade_date", "cash_balance_gbp", F.lit(1).alias("_prio"))
        opened = (self.dim_account.filter(F.col("account_open_date").isNotNull())
                  .select("account_key", "account_name",
                          F.greatest(F.col("account_open_date"), F.lit(self.cal_start).cast("date")).alias("trade_date"),
                          F.lit(0.0).alias("cash_balance_gbp"), F.lit(0).alias("_prio")))
        return moves.unionByName(opened)

    # ---- dense series, either grain -----------------------------------------
    def _fund_values(self, grain: str, window: tuple[str, str] | None = None, fund_id: str | None = None) -> DataFrame:
        """Units times price at each day or month end. ``fund_id`` restricts both series before any window runs.

        The join carries no hint: a broadcast is chosen at run time from the measured size of the exploded
        prices; otherwise both sides are hash-partitioned on (fund, date), which spreads a hot fund over its dates.
        """
        unit_steps, price_steps = self.unit_steps, self.price_steps
        if fund_id is not None:
            unit_steps = unit_steps.filter(F.col("fund_id") == fund_id)
            price_steps = price_steps.filter(F.col("fund_key") == surrogate_key(F.lit(fund_id)))
        units = forward_fill(unit_steps.select("account_key", "account_name", "fund_key", "fund_id",
                                               "trade_date", "units_held"),
                             ["account_key", "fund_key"], "trade_date", self.horizon, grain,
                             min_value=("units_held", OPEN_UNITS), window=window).drop("trade_date")
        prices = forward_fill(price_steps, ["fund_key"], "price_date", self.horizon, grain,
                              window=window).drop("price_date")
        return (units.join(prices, ["fund_key", "date"])
                .select(D.date_key(F.col("date")).alias("date_key"), "account_key", "fund_key",
                        "units_held", "fund_price_gbp",
                        (F.col("units_held") * F.col("fund_price_gbp")).alias("value_gbp"),
                        "date", "account_name", "fund_id"))

    def _cash_values(self, grain: str, window: tuple[str, str] | None = None) -> DataFrame:
        cash = forward_fill(self.cash_steps, ["account_key"], "trade_date", self.horizon, grain,
                            window=window).drop("trade_date")
        return cash.select(D.date_key(F.col("date")).alias("date_key"), "account_key",
                           F.col("cash_balance_gbp").alias("value_gbp"), "date", "account_name")

    def _holdings(self, grain: str, window: tuple[str, str] | None = None) -> DataFrame:
        funds = self._fund_values(grain, window).withColumn("holding_type", F.lit(FUND))
        cash = self._cash_values(grain, window).withColumn("holding_type", F.lit(CASH))
        cols = ["date_key", "account_key", "fund_key", "holding_type", "units_held", "fund_price_gbp",
                "value_gbp", "date", "account_name", "fund_id"]
        return funds.unionByName(cash, allowMissingColumns=True).select(*cols)

    @cached_property
    def units_held_daily(self) -> DataFrame:           # I2 (closed positions included)
        u = forward_fill(self.unit_steps.select("account_key", "account_name", "fund_key", "fund_id",
                                                "trade_date", "units_held"),
                         ["account_key", "fund_key"], "trade_date", self.horizon, "day").drop("trade_date")
        return u.withColumn("date_key", D.date_key(F.col("date")))

    @cached_property
    def fund_values_daily(self) -> DataFrame:          # I3
        return self._fund_values("day")

    @cached_property
    def cash_values_daily(self) -> DataFrame:          # I4
        return self._cash_values("day")

    @cached_property
    def holdings_daily(self) -> DataFrame:             # I5
        return self._holdings("day")

    @cached_property
    def holdings_month_end(self) -> DataFrame:
        return self._holdings("month")

    @staticmethod
    def _value_by_day(holdings: DataFrame) -> DataFrame:
        return (holdings.groupBy("account_name", "date")
                .agg(money(exact_sum("value_gbp")).alias("portfolio_value_gbp"))
                .filter(F.col("portfolio_value_gbp") > 0)
                .select("account_name", F.col("date").alias("valuation_date"), "portfolio_value_gbp"))

    @cached_property
    def portfolio_value_daily(self) -> DataFrame:      # I6
        return self._value_by_day(self.holdings_daily)

    def portfolio_value_between(self, d0: str, d1: str) -> DataFrame:
        """I6 restricted to [d0, d1]: a written daily table is read with the date
        filter pushed to the scan; otherwise only the days in range are generated."""
        if "portfolio_value_daily" in self.materialised:
            return self.portfolio_value_daily.filter(F.col("valuation_date").between(
                F.lit(d0).cast("date"), F.lit(d1).cast("date")))
        return self._value_by_day(self._holdings("day", (d0, d1)))

    # ---- monthly snapshots -------------------------------------------------------
    @cached_property
    def account_month_spine(self) -> DataFrame:        # C6
        return (self._account_months().select("account_key", "account_name", F.explode("months").alias("m"))
                .select("account_key", "account_name", D.year_month(F.col("m")).alias("year_month"),
                        D.financial_year(F.col("m")).alias("financial_year")))

    def _account_months(self) -> DataFrame:
        """(account_key, account_name, months): the first days of each account's complete months."""
        last_month = F.add_months(F.trunc(self.as_of_col, "MM"), -1)
        first = F.greatest(F.trunc("account_open_date", "MM"), F.lit(self.cal_start).cast("date"))
        last = F.least(last_month, F.trunc(F.lit(self.cal_end).cast("date"), "MM"))
        a = self.dim_account.filter(F.col("account_open_date").isNotNull())
        months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))) \
            .otherwise(F.array().cast("array<date>"))      # opened in the as-of month: no complete month yet
        return a.select("account_key", "account_name", months.alias("months"))

    def _monthly_flows(self, keys: list[str]) -> DataFrame:
        t = self.fct_transactions_wide.withColumn("year_month", D.year_month(F.col("trade_date")))
        v, ty = F.col("value_gbp"), F.col("transaction_type")
        return (t.filter(F.col("is_trade") | ty.isin(*INFLOW_TYPES))
                .groupBy(*keys, "year_month")
                .agg(exact_sum(F.when(ty.isin(*INFLOW_TYPES), v)).alias("inflows"),
                     (exact_sum(F.when(ty.isin(*BUY_SIDE), F.abs(v)).otherwise(0.0))
                      - exact_sum(F.when(ty.isin(*SELL_SIDE), F.abs(v)).otherwise(0.0))).alias("net_trades"),
                     F.max(F.col("is_trade").cast("int")).alias("_has_trade")))

    def _account_month_ends(self) -> DataFrame:
        """(account_name, date, value_gbp): each account's holdings at month ends, summed.

        The sparse steps are dealt by account once; filling, pricing and the sum by account and month then move no row of
        the dense series, which has many rows a step. The month-end prices (funds x months) are broadcast if their measured
        size allows.
        """
        cash = self._last_balance(self._cash_moves().drop("account_key"), ["account_name"])
        # one series: united behind the filling, both would have to be dealt once more
        steps = (self.unit_steps.select("account_name", "fund_key", "trade_date", F.col("units_held").alias("held"), F.lit(False).alias("cash"))
                 .unionByName(cash.select("account_name", F.lit(None).cast("string").alias("fund_key"), "trade_date",
                                          F.col("cash_balance_gbp").alias("held"), F.lit(True).alias("cash"))))
        # a fixed number: judged by the size of the sparse steps, partitions would be merged into a few of very many dense rows
        dealt = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        steps = steps.repartition(dealt, "account_name").withColumn("shown", F.when(F.col("cash"), F.lit(float("inf"))).otherwise(F.col("held")))
        filled = forward_fill(steps, ["account_name", "fund_key", "cash"], "trade_date", self.horizon, "month",
                              min_value=("shown", OPEN_UNITS)).select("account_name", "fund_key", "date", "held", "cash")
        prices, _ = broadcast_if_small(forward_fill(self.price_steps, ["fund_key"], "price_date", self.horizon, "month")
                                       .drop("price_date").withColumn("priced", F.lit(True)))
        value = F.when(F.col("cash"), F.col("held")).otherwise(F.col("held") * F.col("fund_price_gbp"))
        return (filled.join(prices, ["fund_key", "date"], "left").filter(F.col("cash") | F.col("priced"))
                .groupBy("account_name", "date").agg(F.sum(value.cast(MONEY_TYPE)).cast("double").alias("value_gbp")))

    @cached_property
    def portfolio_snapshot_monthly(self) -> DataFrame:   # I9
        """One row per account and complete month. Values and flows come as maps by month, one row an account (bounded by the
        calendar), so that accounts are joined where they have been dealt to and no dense row moves."""
        def by_month(rows: DataFrame, month: Column, *cols: str) -> DataFrame:
            entry = F.struct(month.alias("month"), F.struct(*cols).alias("of"))
            return rows.groupBy("account_name").agg(F.map_from_entries(F.collect_list(entry)).alias("months"))

        # keyed by the account name (1:1 with the 32-character surrogate key, far fewer shuffle bytes)
        mev = (self._account_month_ends().withColumn("month_end_value_gbp", money(F.col("value_gbp")))
               .withColumnRenamed("date", "month_end_date"))
        flows = self._monthly_flows(["account_name"]).filter(F.col("account_name").isNotNull())
        values = by_month(mev, F.trunc("month_end_date", "MM"), "month_end_date", "month_end_value_gbp")
        flows = by_month(flows, F.to_date(F.concat("year_month", F.lit("-01"))), "inflows", "net_trades", "_has_trade")
        months = self._account_months().join(values.withColumnRenamed("months", "_values"), "account_name", "left") \
            .join(flows.withColumnRenamed("months", "_flows"), "account_name", "left") \
            .select("account_name", F.explode(F.transform("months", lambda m: F.struct(
                m.alias("m"), F.try_element_at("_values", m).alias("v"), F.try_element_at("_flows", m).alias("f")))).alias("_row")) \
            .select("account_name", "_row.*")
        return months.select("account_name", D.year_month(F.col("m")).alias("year_month"), D.financial_year(F.col("m")).alias("financial_year"),
                             "v.month_end_date", "v.month_end_value_gbp",
                             money(F.coalesce("f.inflows", F.lit(0.0))).alias("monthly_inflows_gbp"),
                             money(F.when(F.col("f._has_trade") == 1, F.col("f.net_trades")).otherwise(0.0))
                             .alias("monthly_net_fund_purchases_gbp"))

    @cached_property
    def fund_snapshot_monthly(self) -> DataFrame:       # I10
        fv = self.holdings_month_end.filter(F.col("holding_type") == FUND)
        mev = (fv.groupBy("account_key", "account_name", "fund_key", "date")
               .agg(money(exact_sum("value_gbp")).alias("month_end_value_gbp")))
        flows = (self._monthly_flows(["account_key", "fund_key"])
                 .filter(F.col("fund_key").isNotNull() & (F.col("_has_trade") == 1)))
        funds = self.dim_fund.select("fund_key", "fund_name", "fund_short_name")
        return (mev.withColumn("year_month", D.year_month(F.col("date")))
                .join(funds, "fund_key")
                .join(flows, ["account_key", "fund_key", "year_month"], "left")
                .select("account_name", "fund_name", "fund_short_name", "year_month",
                        D.financial_year(F.col("date")).alias("financial_year"),
                        F.col("date").alias("month_end_date"), "month_end_value_gbp",
                        money(F.coalesce("net_trades", F.lit(0.0))).alias("monthly_net_fund_flows_gbp")))

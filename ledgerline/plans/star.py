"""Star schema: base views, dimensions and facts.

``Warehouse`` holds the raw source DataFrames and an ``as_of`` date and builds
every model lazily, once per instance (the same DataFrame object is reused by
all downstream models, so Catalyst sees shared subplans and AQE can reuse
exchanges). Nothing is collected.

Join strategy. The calendar is dense, so "inner join dim_date on date" is a
range filter and the date key is computed (``date_key``), not joined; the
transaction-type key is a hash of its natural key and is computed too. The
account and fund dimensions are joined without hints: AQE measures them at
run time and broadcasts them only when they are under the broadcast
threshold, otherwise it keeps the shuffle join.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import dates as D
from ledgerline.functions.numeric import exact_sum
from ledgerline.functions.keys import surrogate_key
from ledgerline.operators.windows import running_sum
from ledgerline.sources.fixture import (CALENDAR_END, CALENDAR_START, FIXTURE_AS_OF, RawSources,
                                        load_raw)

# Fixed values of the domain.
TRADE_TYPES = ("BUY", "SELL", "SWITCH_IN", "SWITCH_OUT")
BUY_SIDE = ("BUY", "SWITCH_IN")
SELL_SIDE = ("SELL", "SWITCH_OUT")
INFLOW_TYPES = ("CONTRIBUTION", "TRANSFER")
ALL_TYPES = ("BUY", "SELL", "SWITCH_IN", "SWITCH_OUT", "CONTRIBUTION", "FEE", "INTEREST",
             "REBATE", "TRANSFER", "REJECTED", "OTHER")
OPEN_UNITS = 0.0001      # a position is open above this many units
SHOWN_UNITS = 0.01       # and shown in "latest holdings" from this many
HOLDING, EXITED = "Holding", "Exited"
TRADE, NON_TRADE = "Trade", "Non-Trade"
CONTRIB, TRANSF, NON_CONTRIB = "Contribution", "Transfer", "Non-Contribution"
FUND, CASH = "Fund", "Cash"


def signed_units():
    """+quantity for buys/switch-ins, -quantity for sells/switch-outs, null otherwise."""
    t, q = F.col("transaction_type"), F.col("quantity")
    return F.when(t.isin(*BUY_SIDE), q).when(t.isin(*SELL_SIDE), -q)


def money(c):
    """Pence-exact money: round to 2 places to drop float summation noise."""
    return F.round(c, 2)


class Warehouse:
    def __init__(self, spark: SparkSession, raw: RawSources, as_of: str = FIXTURE_AS_OF,
                 calendar_start: str = CALENDAR_START, calendar_end: str = CALENDAR_END):
        self.spark = spark
        self.raw = raw
        self.as_of = as_of
        self.cal_start = calendar_start
        self.cal_end = calendar_end
        self.materialised: set[str] = set()    # models held as written tables

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, account_by: str = "nation", **kw) -> "Warehouse":
        w = cls(spark, load_raw(spark, sf_dir, account_by), **kw)
        w.sf_dir = sf_dir
        return w

    def table(self, name: str) -> DataFrame:
        """A test table next to the raw sources (text jobs read documents/conversations)."""
        from ledgerline.sources.fixture import table
        return table(self.spark, self.sf_dir, name)

    # ---- parameters as columns -------------------------------------------
    @property
    def as_of_col(self):
        return F.lit(self.as_of).cast("date")

    def in_calendar(self, c):
        return c.between(F.lit(self.cal_start).cast("date"), F.lit(self.cal_end).cast("date"))

    # ---- base views (B1-B3) ----------------------------------------------
    @cached_property
    def base_transactions(self) -> DataFrame:
        t = self.raw.transactions
        return t.select(
            F.col("id").alias("transaction_id"), "account_id", "fund_id", "trade_date", "settle_date",
            "reference", "raw_description", "transaction_type", "transaction_subtype",
            "unit_cost_pence", "quantity", "value_gbp",
            F.col("transaction_type").isin(*TRADE_TYPES).alias("is_trade"),
            F.col("transaction_type").isin(*INFLOW_TYPES).alias("is_contribution"),
            F.when(F.col("value_gbp") < 0, 1).otherwise(-1).alias("unit_direction"),
        )

    @cached_property
    def base_prices(self) -> DataFrame:
        p = self.raw.prices
        return p.select("fund_id", F.col("date").alias("price_date"), "price_pence",
                        (F.col("price_pence") / F.lit(100.0)).alias("price_gbp"), "source")

    @cached_property
    def base_benchmarks(self) -> DataFrame:
        b = self.raw.benchmarks
        return b.select("index_id", F.col("date").alias("market_date"),
                        F.col("level").alias("index_level"), "ticker")

    def dated_sources(self) -> DataFrame:
        """(source, date) of every dated raw row."""
        r = self.raw
        parts = [r.transactions.select(F.lit("transactions").alias("source"), F.col("trade_date").alias("date")),
                 r.transactions.select(F.lit("settlements").alias("source"), F.col("settle_date").alias("date")),
                 r.prices.select(F.lit("prices").alias("source"), "date"),
                 r.benchmarks.select(F.lit("benchmarks").alias("source"), "date")]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.filter(F.col("date").isNotNull())

    def seeded_calendar(self) -> DataFrame:
        """Whole years from the first to the last date of the sources (two days are resolved first)."""
        lo, hi = self.dated_sources().agg(F.min("date"), F.max("date")).first()
        return D.calendar(self.spark, f"{lo:%Y}-01-01", f"{hi:%Y}-12-31")

    def outside_calendar(self) -> DataFrame:
        """Rows by source that the model's calendar covers and leaves out: nothing is dropped uncounted."""
        inside = self.in_calendar(F.col("date"))
        return self.dated_sources().groupBy("source").agg(
            F.count_if(inside).alias("rows_inside"), F.count_if(~inside).alias("rows_outside"))

    # ---- dimensions ------------------------------------------------------
    @cached_property
    def dim_date(self) -> DataFrame:
        return D.calendar(self.spark, self.cal_start, self.cal_end)

    @cached_property
    def dim_account(self) -> DataFrame:
        opened = (self.base_transactions.groupBy("account_id")
                  .agg(F.min("trade_date").alias("account_open_date")))
        a = self.raw.accounts
        return (a.join(opened, a.id == opened.account_id, "left")
                 .select(surrogate_key(a.id).alias("account_key"), a.id.alias("account_name"),
                         "account_open_date"))

    @cached_property
    def fund_unit_history(self) -> DataFrame:
        """Cumulative units per fund (all accounts) on each trade date (D2 -> E1)."""
        deltas = (self.base_transactions
                  .filter(F.col("is_trade") & F.col("fund_id").isNotNull())
                  .groupBy("fund_id", "trade_date").agg(exact_sum(signed_units()).alias("unit_delta")))
        return running_sum(deltas, ["fund_id"], "trade_date", "unit_delta", "cumulative_units")

    @cached_property
    def dim_fund(self) -> DataFrame:
        """Fund lifecycle. One groupBy over the per-fund history gives the
        latest units (``max_by``) and the last date with an open position."""
        h = self.fund_unit_history
        pos = h.groupBy("fund_id").agg(
            F.max_by("cumulative_units", "trade_date").alias("latest_units"),
            F.max(F.when(F.col("cumulative_units") > OPEN_UNITS, F.col("trade_date"))).alias("last_held_date"))
        first = (self.base_transactions
                 .filter(F.col("transaction_type").isin(*BUY_SIDE) & F.col("fund_id").isNotNull())
                 .groupBy("fund_id").agg(F.min("trade_date").alias("first_investment_date")))
        f = self.raw.funds
        holding = F.col("latest_units") > OPEN_UNITS
        return (f.join(pos, f.id == pos.fund_id, "left").drop("fund_id")
                 .join(first, f.id == first.fund_id, "left")
                 .select(surrogate_key(f.id).alias("fund_key"), f.id.alias("fund_id"),
                         f.name.alias("fund_name"), f.short_name.alias("fund_short_name"),
                         "morningstar_code", "first_investment_date",
                         F.when(holding, F.lit(None).cast("date")).otherwise(F.col("last_held_date"))
                          .alias("last_position_date"),
                         F.when(holding, HOLDING).otherwise(EXITED).alias("investment_status_indicator")))

    @cached_property
    def dim_transaction_type(self) -> DataFrame:
        t = F.col("transaction_type")
        return (self.base_transactions
                .select("transaction_type", "transaction_subtype", "is_trade", "is_contribution").distinct()
                .select(surrogate_key("transaction_type", "transaction_subtype").alias("transaction_type_key"),
                        "transaction_type", "transaction_subtype",
                        F.when(F.col("is_trade"), TRADE).otherwise(NON_TRADE).alias("trade_indicator"),
                        F.when(t == "CONTRIBUTION", CONTRIB).when(t == "TRANSFER", TRANSF)
                         .otherwise(NON_CONTRIB).alias("contribution_indicator")))

    # ---- facts -------------------------------------------------------------
    @cached_property
    def fct_transactions_wide(self) -> DataFrame:
        """Transaction fact with natural keys kept alongside surrogate keys.

        Trades outside the calendar are dropped (the inner calendar join);
        settle dates outside it get a null key (the left join).
        """
        t = self.base_transactions.filter(self.in_calendar(F.col("trade_date")))
        acc = self.dim_account.select("account_key", F.col("account_name").alias("_acc"))
        fnd = self.dim_fund.select("fund_key", F.col("fund_id").alias("_fid"))
        return (t.join(acc, t.account_id == acc._acc, "left")
                 .join(fnd, t.fund_id == fnd._fid, "left")
                 .select("account_key", "fund_key",
                         surrogate_key("transaction_type", "transaction_subtype").alias("transaction_type_key"),
                         D.date_key(F.col("trade_date")).alias("trade_date_key"),
                         F.when(self.in_calendar(F.col("settle_date")), D.date_key(F.col("settle_date")))
                          .alias("settle_date_key"),
                         "transaction_id", F.col("reference").alias("transaction_reference"),
                         F.col("raw_description").alias("transaction_full_description"),
                         "quantity", "value_gbp",
                         # natural keys and type attributes for downstream models
                         F.col("_acc").alias("account_name"), F.col("_fid").alias("fund_id"),
                         "trade_date", "settle_date", "transaction_type", "transaction_subtype",
                         "is_trade", "is_contribution"))

    @cached_property
    def fct_transactions(self) -> DataFrame:
        return self.fct_transactions_wide.select(
            "account_key", "fund_key", "transaction_type_key", "trade_date_key", "settle_date_key",
            "transaction_id", "transaction_reference", "transaction_full_description", "quantity", "value_gbp")

    @cached_property
    def fct_fund_prices_daily(self) -> DataFrame:
        p = self.base_prices.filter(self.in_calendar(F.col("price_date")))
        f = self.dim_fund.select("fund_key", F.col("fund_id").alias("_fid"))
        return (p.join(f, p.fund_id == f._fid)
                 .select(D.date_key(F.col("price_date")).alias("date_key"), "fund_key",
                         F.col("price_gbp").alias("fund_price_gbp"), "fund_id", "price_date"))

    @cached_property
    def fct_benchmarks_monthly(self) -> DataFrame:
        """Last level of each month, stamped with the calendar month end."""
        b = self.base_benchmarks.filter(self.in_calendar(F.col("market_date")))
        return (b.groupBy("index_id", "ticker", D.year_month(F.col("market_date")).alias("year_month"))
                 .agg(F.max_by("index_level", "market_date").alias("month_end_level"),
                      F.last_day(F.max("market_date")).alias("month_end_date"))
                 .select(D.date_key(F.col("month_end_date")).alias("date_key"), "index_id", "ticker",
                         "year_month", "month_end_level", "month_end_date"))

    @cached_property
    def fct_cash_position_daily(self) -> DataFrame:
        """D3 + E2: cash movement buckets per account-day and the running balance."""
        t = self.fct_transactions_wide.filter(F.col("account_key").isNotNull())
        v, ty = F.col("value_gbp"), F.col("transaction_type")
        trade = F.col("is_trade")
        inflow = ty.isin(*INFLOW_TYPES)
        daily = (t.groupBy("account_key", "account_name", "trade_date")
                 .agg(exact_sum(F.when(trade, v).otherwise(0.0)).alias("trade_cash_net_gbp"),
                      exact_sum(F.when(inflow, v).otherwise(0.0)).alias("inflows_gbp"),
                      exact_sum(F.when(~trade & ~inflow, v).otherwise(0.0)).alias("fees_and_other_gbp"),
                      exact_sum(v).alias("net_cash_movement_gbp")))
        daily = running_sum(daily, ["account_key"], "trade_date", "net_cash_movement_gbp", "cash_balance_gbp")
        return daily.withColumn("date_key", D.date_key(F.col("trade_date")))

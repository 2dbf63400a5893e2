"""Registered queries and their DuckDB oracles.

Output conventions: money rounded to 2 places, ratios to 6, every computed
column aliased identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.oracle import CALENDAR_COLUMNS
from ledgerline.plans.catalog import register
from ledgerline.plans.returns import TRAILING_COLS, ratio
from ledgerline.plans.star import money


def _r6(df, *cols):
    return df.select(*[ratio(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _m2(df, *cols):
    return df.select(*[money(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


R6 = "round({0}, 6) AS {0}"
M2 = "round({0}, 2) AS {0}"


# ---------------------------------------------------------------- star schema
_DATED = """
, dated(source, date) AS (
    SELECT 'transactions', trade_date FROM raw_transactions UNION ALL SELECT 'settlements', settle_date FROM raw_transactions
    UNION ALL SELECT 'prices', date FROM raw_prices UNION ALL SELECT 'benchmarks', date FROM raw_benchmarks)"""


@register("calendar_seed", oracle=_DATED + f"""
, bounds AS (SELECT date_trunc('year', min(date)) AS lo, date_trunc('year', max(date)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS hi
             FROM dated)
{CALENDAR_COLUMNS}
  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM bounds)""")
def calendar_seed(p):
    return p.seeded_calendar()


@register("rows_outside_calendar", oracle=_DATED + """
SELECT source, count(*) FILTER (WHERE date IN (SELECT date FROM dim_date)) AS rows_inside,
       count(*) FILTER (WHERE date NOT IN (SELECT date FROM dim_date)) AS rows_outside
FROM dated WHERE date IS NOT NULL GROUP BY 1""")
def rows_outside_calendar(p):
    return p.outside_calendar()


@register("dim_account", oracle="SELECT account_key, account_name, account_open_date FROM dim_account")
def dim_account(p):
    return p.dim_account


@register("dim_fund_lifecycle", oracle="""
SELECT fund_key, fund_id, fund_name, fund_short_name, morningstar_code, first_investment_date,
       last_position_date, investment_status_indicator FROM dim_fund""")
def dim_fund_lifecycle(p):
    return p.dim_fund


@register("distinct_combinations", oracle="SELECT * FROM dim_transaction_type")
def distinct_combinations(p):
    return p.dim_transaction_type


@register("fct_transactions", oracle="""
SELECT account_key, fund_key, transaction_type_key, trade_date_key, settle_date_key, transaction_id,
       transaction_reference, transaction_full_description, quantity, value_gbp FROM fct""")
def fct_transactions(p):
    return p.fct_transactions


@register("fct_fund_prices_daily", oracle="SELECT date_key, fund_key, fund_price_gbp FROM fct_fund_prices_daily")
def fct_fund_prices_daily(p):
    return p.fct_fund_prices_daily.select("date_key", "fund_key", "fund_price_gbp")


@register("last_in_group_ordered", oracle="""
SELECT date_key, index_id, ticker, year_month, month_end_level FROM fct_benchmarks_monthly""")
def last_in_group_ordered(p):
    return p.fct_benchmarks_monthly.select("date_key", "index_id", "ticker", "year_month", "month_end_level")


@register("cash_movement_buckets", oracle=f"""
SELECT date_key, account_key, {M2.format('trade_cash_net_gbp')}, {M2.format('inflows_gbp')},
       {M2.format('fees_and_other_gbp')}, {M2.format('net_cash_movement_gbp')}, {M2.format('cash_balance_gbp')}
FROM fct_cash_position_daily""")
def cash_movement_buckets(p):
    df = p.fct_cash_position_daily.select("date_key", "account_key", "trade_cash_net_gbp", "inflows_gbp",
                                          "fees_and_other_gbp", "net_cash_movement_gbp", "cash_balance_gbp")
    return _m2(df, "trade_cash_net_gbp", "inflows_gbp", "fees_and_other_gbp", "net_cash_movement_gbp",
               "cash_balance_gbp")


# ------------------------------------------------------------ dense snapshots
@register("units_held_daily", oracle="SELECT date_key, account_key, fund_key, units_held FROM units_daily")
def units_held_daily(p):
    return p.units_held_daily.select("date_key", "account_key", "fund_key", "units_held")


@register("asof_inner_join", oracle=f"""
SELECT date_key, account_key, fund_key, units_held, fund_price_gbp, {M2.format('value_gbp')}
FROM fund_values_daily""")
def fund_value_daily(p):
    df = p.fund_values_daily.select("date_key", "account_key", "fund_key", "units_held", "fund_price_gbp",
                                    "value_gbp")
    return _m2(df, "value_gbp")


@register("asof_left_join", oracle=f"SELECT date_key, account_key, {M2.format('value_gbp')} FROM cash_values_daily")
def cash_value_daily(p):
    return _m2(p.cash_values_daily.select("date_key", "account_key", "value_gbp"), "value_gbp")


@register("holdings_daily", oracle=f"""
SELECT date_key, account_key, fund_key, holding_type, units_held, fund_price_gbp, {M2.format('value_gbp')}
FROM holdings_daily""")
def holdings_daily(p):
    df = p.holdings_daily.select("date_key", "account_key", "fund_key", "holding_type", "units_held",
                                 "fund_price_gbp", "value_gbp")
    return _m2(df, "value_gbp")


@register("portfolio_value_daily", oracle="SELECT * FROM portfolio_value_daily")
def portfolio_value_daily(p):
    return p.portfolio_value_daily


@register("portfolio_snapshot_monthly", oracle="SELECT * FROM portfolio_snapshot_monthly")
def portfolio_snapshot_monthly(p):
    return p.portfolio_snapshot_monthly


@register("fund_snapshot_monthly", oracle="SELECT * FROM fund_snapshot_monthly")
def fund_snapshot_monthly(p):
    return p.fund_snapshot_monthly


# -------------------------------------------------------------------- returns
@register("portfolio_returns_monthly", oracle=f"""
SELECT account_name, year_month, financial_year, month_end_date, month_end_value_gbp, prev_month_end_value_gbp,
       month_inflows_gbp, {R6.format('monthly_return')}, {', '.join(R6.format(c) for c in TRAILING_COLS)}
FROM portfolio_returns_monthly""")
def portfolio_returns_monthly(p):
    return _r6(p.portfolio_returns_monthly, "monthly_return", *TRAILING_COLS)


@register("modified_dietz_fund", oracle=f"""
SELECT account_name, fund_name, fund_short_name, year_month, financial_year, month_end_date, month_end_value_gbp,
       prev_month_end_value_gbp, month_net_flows_gbp, {R6.format('monthly_return')}
FROM fund_returns_monthly""")
def modified_dietz_fund(p):
    return _r6(p.fund_returns_monthly, "monthly_return")


@register("benchmark_returns_monthly", oracle=f"""
SELECT index_id, ticker, year_month, month_end_date, month_end_level, prev_month_end_level,
       {R6.format('monthly_return')}, {', '.join(R6.format(c) for c in TRAILING_COLS)}
FROM benchmark_returns_monthly""")
def benchmark_returns_monthly(p):
    return _r6(p.benchmark_returns_monthly, "monthly_return", *TRAILING_COLS)


# ----------------------------------------------- customer grain (scale variant of I9 / I13)
# One account per customer: the dense series grow with the data (customers x brands x
# months), so these exercise the entity-partitioned windows and as-of explodes on many keys.
@register("portfolio_snapshot_monthly_by_customer", oracle="SELECT * FROM portfolio_snapshot_monthly",
          account_by="customer", oracle_models={"spine": "month"})
def portfolio_snapshot_monthly_by_customer(p):
    return p.portfolio_snapshot_monthly


@register("portfolio_returns_monthly_by_customer", oracle=f"""
SELECT account_name, year_month, financial_year, month_end_date, month_end_value_gbp, prev_month_end_value_gbp,
       month_inflows_gbp, {R6.format('monthly_return')}, {', '.join(R6.format(c) for c in TRAILING_COLS)}
FROM portfolio_returns_monthly""", account_by="customer", oracle_models={"spine": "month"})
def portfolio_returns_monthly_by_customer(p):
    return _r6(p.portfolio_returns_monthly, "monthly_return", *TRAILING_COLS)

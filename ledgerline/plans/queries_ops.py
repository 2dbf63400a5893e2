"""One registered query per remaining SURVEY section-2 operator.

These operators run inside the larger marts already; here each gets its own
key, a focused output and its own oracle, so every operator is checked on
its own. A few keys name the mart that *is* the operator (``aliases``).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import dates as D
from ledgerline.functions.keys import surrogate_key
from ledgerline.functions.numeric import exact_sum
from ledgerline.operators.asof import asof_join, step_intervals
from ledgerline.plans import catalog
from ledgerline.plans.catalog import register
from ledgerline.plans.declared_checks import declared_sql, run_declared
from ledgerline.plans import queries_more as QM
from ledgerline.plans.queries_more import REBASE_MONTH
from ledgerline.plans.queries_serving import ACCOUNT_A, AS_OF, MONTH_RETURN, SERIES_FROM
from ledgerline.plans.returns import ratio
from ledgerline.plans.star import (BUY_SIDE, FUND, INFLOW_TYPES, OPEN_UNITS, SHOWN_UNITS, money,
                                   signed_units)
from ledgerline.plans.queries_ingest import _scan
from ledgerline.sources import broker_csv as B

RANGE_FROM, RANGE_TO = "1998-01-01", "1998-12-31"
LATEST_TO = "2000-06-30"


def alias(name: str, of: str):
    """Register ``name`` as the same query and oracle as ``of`` (the mart is the operator)."""
    catalog._SPARK[name] = catalog._SPARK[of]
    if of in catalog._ORACLE:
        catalog._ORACLE[name] = catalog._ORACLE[of]


for _name, _of in [("fund_value_daily", "asof_inner_join"), ("cash_value_daily", "asof_left_join"),
                   ("union_all_null_padded", "holdings_daily"), ("having_on_aggregate", "portfolio_value_daily"),
                   ("conditional_pivot", "contributions_fy_pivot"), ("agg_of_agg_share", "allocation_as_of"),
                   ("group_by_expression", "holdings_combined"), ("star_inner_join", "fct_fund_prices_daily"),
                   ("transaction_log", "transaction_page"), ("left_outer_enrich", "portfolio_snapshot_monthly"),
                   ("semi_join_in_list", "fund_value_history")]:
    alias(_name, _of)


# ------------------------------------------------------------------ B
@register("base_transactions", oracle="""
SELECT transaction_id, account_id, fund_id, trade_date, transaction_type, value_gbp, is_trade, is_contribution,
       CASE WHEN value_gbp < 0 THEN 1 ELSE -1 END AS unit_direction FROM base_tx""")
def base_transactions(p):
    return p.base_transactions.select("transaction_id", "account_id", "fund_id", "trade_date", "transaction_type",
                                      "value_gbp", "is_trade", "is_contribution", "unit_direction")


@register("base_prices", oracle="SELECT fund_id, date AS price_date, price_pence, price_pence / 100.0 AS price_gbp FROM raw_prices")
def base_prices(p):
    return p.base_prices.select("fund_id", "price_date", "price_pence", "price_gbp")


@register("base_benchmarks", oracle="SELECT index_id, date AS market_date, level AS index_level, ticker FROM raw_benchmarks")
def base_benchmarks(p):
    return p.base_benchmarks


@register("surrogate_key", oracle="""
SELECT 'account' AS entity, id AS natural_key, md5(coalesce(CAST(id AS VARCHAR), '_dbt_utils_surrogate_key_null_')) AS sk
FROM raw_accounts
UNION ALL
SELECT DISTINCT 'transaction_type', transaction_type || '/' || coalesce(transaction_subtype, ''),
       md5(coalesce(transaction_type, '_dbt_utils_surrogate_key_null_') || '-'
           || coalesce(transaction_subtype, '_dbt_utils_surrogate_key_null_'))
FROM raw_transactions""")
def surrogate_key_q(p):
    a = p.raw.accounts.select(F.lit("account").alias("entity"), F.col("id").alias("natural_key"),
                              surrogate_key("id").alias("sk"))
    t = (p.raw.transactions.select("transaction_type", "transaction_subtype").distinct()
         .select(F.lit("transaction_type").alias("entity"),
                 F.concat_ws("/", "transaction_type", F.coalesce("transaction_subtype", F.lit(""))).alias("natural_key"),
                 surrogate_key("transaction_type", "transaction_subtype").alias("sk")))
    return a.unionByName(t)


@register("date_range_filter", oracle=f"""
SELECT * FROM portfolio_value_daily
WHERE valuation_date BETWEEN DATE '{RANGE_FROM}' AND DATE '{RANGE_TO}' AND account_name = '{ACCOUNT_A}'""")
def date_range_filter(p):
    return p.portfolio_value_between(RANGE_FROM, RANGE_TO).filter(F.col("account_name") == ACCOUNT_A)


@register("open_position_filter", oracle=f"""
SELECT account_key, fund_key, count(*) FILTER (WHERE units_held > {OPEN_UNITS}) AS open_days,
       count(*) FILTER (WHERE units_held >= {SHOWN_UNITS}) AS shown_days
FROM units_daily GROUP BY 1, 2""")
def open_position_filter(p):
    """Days by the length of each validity interval; no day is generated."""
    steps = step_intervals(p.unit_steps, ["account_key", "fund_key"], "trade_date", p.horizon)
    days = F.datediff("valid_to", "trade_date") + 1
    return steps.groupBy("account_key", "fund_key").agg(
        F.sum(F.when(F.col("units_held") > OPEN_UNITS, days).otherwise(0)).alias("open_days"),
        F.sum(F.when(F.col("units_held") >= SHOWN_UNITS, days).otherwise(0)).alias("shown_days"))


def _scanned(p):
    return B.parse_broker_rows(_scan(p))


@register("parse_uk_date", oracle="SELECT account_id, reference, trade_date, settle_date FROM raw_transactions")
def parse_uk_date(p):
    return _scanned(p).select("account_id", "reference", "trade_date", "settle_date")


@register("parse_number", oracle="""
SELECT account_id, reference, unit_cost_pence, quantity, value_gbp FROM raw_transactions""")
def parse_number(p):
    return _scanned(p).select("account_id", "reference", "unit_cost_pence", "quantity", "value_gbp")


# ------------------------------------------------------------------ C
@register("star_left_join", oracle="""
SELECT f.transaction_id, f.account_name, df.fund_name FROM fct f LEFT JOIN dim_fund df ON df.fund_key = f.fund_key""")
def star_left_join(p):
    f = p.dim_fund.select("fund_key", "fund_name")
    return p.fct_transactions_wide.join(f, "fund_key", "left").select("transaction_id", "account_name", "fund_name")


@register("role_playing_date_join", oracle="""
SELECT f.transaction_id, t.year_month AS trade_year_month, s.financial_year AS settle_financial_year
FROM fct f JOIN dim_date t ON t.date_key = f.trade_date_key LEFT JOIN dim_date s ON s.date_key = f.settle_date_key""")
def role_playing_date_join(p):
    cal = p.dim_date
    t = cal.select(F.col("date_key").alias("trade_date_key"), F.col("year_month").alias("trade_year_month"))
    s = cal.select(F.col("date_key").alias("settle_date_key"), F.col("financial_year").alias("settle_financial_year"))
    # the calendar is bounded (one row per day), so both role joins broadcast it
    return (p.fct_transactions.join(F.broadcast(t), "trade_date_key")
            .join(F.broadcast(s), "settle_date_key", "left")
            .select("transaction_id", "trade_year_month", "settle_financial_year"))


@register("null_safe_join", oracle="""
SELECT t.transaction_id, d.transaction_type_key, d.trade_indicator, d.contribution_indicator
FROM base_tx t JOIN dim_transaction_type d ON d.transaction_type = t.transaction_type
 AND d.transaction_subtype IS NOT DISTINCT FROM t.transaction_subtype""")
def null_safe_join(p):
    d = p.dim_transaction_type
    t = p.base_transactions
    # the type dimension is bounded by the distinct (type, subtype) pairs, a few dozen rows
    return t.join(F.broadcast(d), (t.transaction_type == d.transaction_type)
                  & t.transaction_subtype.eqNullSafe(d.transaction_subtype)) \
        .select(t.transaction_id, d.transaction_type_key, d.trade_indicator, d.contribution_indicator)


@register("date_spine_range_join", oracle=f"""
SELECT da.account_name, min(dd.date) AS first_day, max(dd.date) AS last_day, count(*) AS days
FROM dim_account da JOIN dim_date dd ON dd.date >= da.account_open_date AND dd.date <= DATE '{AS_OF}'
GROUP BY 1""")
def date_spine_range_join(p):
    """The spine is dense, so its ends and length follow from the opening day and the horizon."""
    first = F.greatest("account_open_date", F.lit(p.cal_start).cast("date"))
    last = F.lit(p.horizon).cast("date")
    return p.dim_account.filter(first <= last).select(
        "account_name", first.alias("first_day"), last.alias("last_day"), (F.datediff(last, first) + 1).cast("bigint").alias("days"))


@register("asof_events_bucketed", raw_oracle="""
WITH views AS (SELECT user_id, ts AS view_ts, max(value) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, p.user_id, p.ts, v.view_ts, v.view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN views v ON p.user_id = v.user_id AND p.ts >= v.view_ts""")
def asof_events_bucketed(p):
    """Each purchase with the user's last view before it, by the skew-safe form: one window per (user, week)."""
    e = p.table("events")
    views = (e.filter(F.col("event_type") == "view").groupBy("user_id", F.col("ts").alias("view_ts"))
             .agg(F.max("value").alias("view_value")))
    bought = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    return asof_join(bought, views, ["user_id"], "ts", "view_ts", ["view_ts", "view_value"],
                     bucket=lambda t: F.date_trunc("week", t)).select("event_id", "user_id", "ts", "view_ts", "view_value")


@register("month_spine", oracle=f"""
SELECT da.account_name, dd.year_month, max(dd.financial_year) AS financial_year
FROM dim_account da JOIN dim_date dd ON dd.date >= da.account_open_date AND dd.date < date_trunc('month', DATE '{AS_OF}')
GROUP BY 1, 2""")
def month_spine(p):
    return p.account_month_spine.select("account_name", "year_month", "financial_year")


@register("scalar_max_join", oracle="SELECT account_name, holding_type, fund_name, valuation_date, value_gbp FROM holdings_latest")
def scalar_max_join(p):
    return p.holdings_latest.select("account_name", "holding_type", "fund_name", "valuation_date", "value_gbp")


@register("scalar_subquery_filter", oracle=f"""
SELECT account_name, month_end_date, round(monthly_return, 6) AS monthly_return FROM portfolio_returns_monthly
WHERE month_end_date = (SELECT max(month_end_date) FROM portfolio_returns_monthly WHERE month_end_date <= DATE '{LATEST_TO}')""")
def scalar_subquery_filter(p):
    r = p.portfolio_returns_monthly
    last = r.filter(F.col("month_end_date") <= F.lit(LATEST_TO).cast("date")).select(F.max("month_end_date")).scalar()
    return r.filter(F.col("month_end_date") == last).select("account_name", "month_end_date",
                                                            ratio(F.col("monthly_return")).alias("monthly_return"))


# ------------------------------------------------------------------ D
@register("group_min_max", oracle="""
SELECT 'account' AS entity, account_name AS name, account_open_date AS first_date FROM dim_account
UNION ALL
SELECT 'fund', fund_id, first_investment_date FROM dim_fund""")
def group_min_max(p):
    a = p.dim_account.select(F.lit("account").alias("entity"), F.col("account_name").alias("name"),
                             F.col("account_open_date").alias("first_date"))
    f = p.dim_fund.select(F.lit("fund").alias("entity"), F.col("fund_id").alias("name"),
                          F.col("first_investment_date").alias("first_date"))
    return a.unionByName(f)


@register("signed_unit_delta", oracle="""
SELECT account_key, fund_key, trade_date,
       sum(CASE WHEN transaction_type IN ('BUY', 'SWITCH_IN') THEN quantity
                WHEN transaction_type IN ('SELL', 'SWITCH_OUT') THEN -quantity END) AS unit_delta
FROM fct WHERE trade_indicator = 'Trade' AND fund_key IS NOT NULL GROUP BY 1, 2, 3""")
def signed_unit_delta(p):
    t = p.fct_transactions_wide.filter(F.col("is_trade") & F.col("fund_key").isNotNull())
    return t.groupBy("account_key", "fund_key", "trade_date").agg(exact_sum(signed_units()).alias("unit_delta"))


@register("conditional_max_date", oracle="""
SELECT fund_id, sum(units) AS latest_units, max(trade_date) FILTER (level > 0.0001) AS last_held_date FROM fund_moves GROUP BY 1""")
def conditional_max_date(p):
    h = p.fund_unit_history
    return h.groupBy("fund_id").agg(
        F.max_by("cumulative_units", "trade_date").alias("latest_units"),
        F.max(F.when(F.col("cumulative_units") > OPEN_UNITS, F.col("trade_date"))).alias("last_held_date"))


@register("buy_cost", oracle="""
SELECT account_key, fund_key, round(buys, 2) AS total_cost_gbp, round(sells, 2) AS total_proceeds_gbp FROM cost_basis""")
def buy_cost(p):
    c = p.cost_basis
    return c.select("account_key", "fund_key", money(F.col("total_cost_gbp")).alias("total_cost_gbp"),
                    money(F.col("total_proceeds_gbp")).alias("total_proceeds_gbp"))


alias("sell_proceeds", "buy_cost")


@register("net_flows_monthly", oracle="""
, sided AS (SELECT account_key, fund_key, year_month, abs(value_gbp) * if(transaction_type IN ('BUY', 'SWITCH_IN'), 1, -1) AS flow
            FROM fct WHERE trade_indicator = 'Trade' AND fund_key IS NOT NULL)
SELECT account_key, fund_key, year_month, round(sum(flow), 2) AS net_flows_gbp FROM sided GROUP BY ALL""")
def net_flows_monthly(p):
    """Money that went into a fund less what came out: each trade's size, signed by its side."""
    t = p.fct_transactions_wide.filter(F.col("is_trade") & F.col("fund_key").isNotNull())
    side = F.when(F.col("transaction_type").isin(*BUY_SIDE), 1).otherwise(-1)
    return t.groupBy("account_key", "fund_key", D.year_month(F.col("trade_date")).alias("year_month")).agg(
        money(exact_sum(F.abs("value_gbp") * side)).alias("net_flows_gbp"))


@register("external_inflows_monthly", oracle="""
SELECT account_key, year_month, round(sum(value_gbp), 2) AS inflows_gbp FROM fct
WHERE contribution_indicator IN ('Contribution', 'Transfer') GROUP BY 1, 2""")
def external_inflows_monthly(p):
    t = p.fct_transactions_wide.filter(F.col("transaction_type").isin(*INFLOW_TYPES))
    return t.groupBy("account_key", D.year_month(F.col("trade_date")).alias("year_month")).agg(
        money(exact_sum("value_gbp")).alias("inflows_gbp"))


@register("weighted_average", oracle=MONTH_RETURN + """
SELECT month_end_date, round(r, 6) AS monthly_return FROM wr""")
def weighted_average(p):
    w = p.weighted_monthly_return(SERIES_FROM, AS_OF)
    return w.select("month_end_date", ratio(F.col("monthly_return")).alias("monthly_return"))


@register("grand_totals", oracle="""
SELECT round(sum(value_gbp), 2) AS total_value_gbp, round(sum(cost_basis_gbp), 2) AS total_cost_gbp,
       round(sum(unrealised_gain_gbp), 2) AS total_gain_gbp,
       round(CASE WHEN sum(cost_basis_gbp) > 0 THEN sum(unrealised_gain_gbp) / sum(cost_basis_gbp) * 100 END, 6)
         AS total_gain_pct
FROM holdings_latest WHERE holding_type = 'Fund'""")
def grand_totals(p):
    h = p.holdings_latest.filter(F.col("holding_type") == FUND)
    cost, gain = exact_sum("cost_basis_gbp"), exact_sum("unrealised_gain_gbp")
    return h.agg(money(exact_sum("value_gbp")).alias("total_value_gbp"), money(cost).alias("total_cost_gbp"),
                 money(gain).alias("total_gain_gbp"),
                 ratio(F.when(cost > 0, gain / cost * 100)).alias("total_gain_pct"))


@register("distinct_pairs", oracle="SELECT DISTINCT fund_id, fund_name FROM fct f JOIN dim_fund USING (fund_id)")
def distinct_pairs(p):
    f = p.dim_fund.select("fund_id", "fund_name")
    return p.fct_transactions_wide.select("fund_id").join(f, "fund_id").distinct()


# ------------------------------------------------------------------ E
@register("running_units", oracle="SELECT account_key, fund_key, trade_date, units_held FROM unit_cum")
def running_units(p):
    return p.unit_steps.select("account_key", "fund_key", "trade_date", "units_held")


@register("running_cash_balance", oracle="""
SELECT account_key, date_key, round(cash_balance_gbp, 2) AS cash_balance_gbp FROM fct_cash_position_daily""")
def running_cash_balance(p):
    return p.fct_cash_position_daily.select("account_key", "date_key", money(F.col("cash_balance_gbp")).alias("cash_balance_gbp"))


@register("running_inflows", oracle="""
SELECT account_name, inflow_date, round(inflow_today, 2) AS inflow_today,
       round(cumulative_inflows_gbp, 2) AS cumulative_inflows_gbp FROM cum_inflows""")
def running_inflows(p):
    d = p.daily_inflows
    return d.select("account_name", "inflow_date", money(F.col("inflow_today")).alias("inflow_today"),
                    money(F.col("cumulative_inflows_gbp")).alias("cumulative_inflows_gbp"))


@register("latest_row_per_key", oracle="""
SELECT fund_id, trade_date, level AS cumulative_units FROM fund_moves
QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY trade_date DESC) = 1""")
def latest_row_per_key(p):
    h = p.fund_unit_history
    w = Window.partitionBy("fund_id").orderBy(F.col("trade_date").desc())
    return (h.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .select("fund_id", "trade_date", "cumulative_units"))


@register("lag_period", oracle="""
SELECT account_name, year_month, month_end_value_gbp,
       lag(month_end_value_gbp) OVER (PARTITION BY account_name ORDER BY year_month) AS prev_month_end_value_gbp
FROM portfolio_snapshot_monthly""")
def lag_period(p):
    from ledgerline.operators.windows import lag_value
    s = p.portfolio_snapshot_monthly.select("account_name", "year_month", "month_end_value_gbp")
    return lag_value(s, ["account_name"], "year_month", "month_end_value_gbp", "prev_month_end_value_gbp")


@register("trailing_count_gate", oracle="""
SELECT account_name, year_month, trailing_12m_return IS NOT NULL AS has_12m,
       trailing_36m_return_annualised IS NOT NULL AS has_36m FROM portfolio_returns_monthly""")
def trailing_count_gate(p):
    r = p.portfolio_returns_monthly
    return r.select("account_name", "year_month", F.col("trailing_12m_return").isNotNull().alias("has_12m"),
                    F.col("trailing_36m_return_annualised").isNotNull().alias("has_36m"))


@register("trailing_compound_return", oracle="""
SELECT account_name, year_month, round(trailing_12m_return, 6) AS trailing_12m_return,
       round(trailing_36m_return_annualised, 6) AS trailing_36m_return_annualised FROM portfolio_returns_monthly""")
def trailing_compound_return(p):
    r = p.portfolio_returns_monthly
    return r.select("account_name", "year_month", ratio(F.col("trailing_12m_return")).alias("trailing_12m_return"),
                    ratio(F.col("trailing_36m_return_annualised")).alias("trailing_36m_return_annualised"))


@register("trailing_sharpe", oracle="""
SELECT index_id, year_month, round(trailing_12m_sharpe, 6) AS trailing_12m_sharpe,
       round(trailing_36m_sharpe, 6) AS trailing_36m_sharpe FROM benchmark_returns_monthly""")
def trailing_sharpe(p):
    r = p.benchmark_returns_monthly
    return r.select("index_id", "year_month", ratio(F.col("trailing_12m_sharpe")).alias("trailing_12m_sharpe"),
                    ratio(F.col("trailing_36m_sharpe")).alias("trailing_36m_sharpe"))


@register("share_of_partition", oracle="SELECT account_name, holding_type, fund_name, weight_pct FROM holdings_latest")
def share_of_partition(p):
    return p.holdings_latest.select("account_name", "holding_type", "fund_name", "weight_pct")


@register("cumprod_index", oracle=QM.REBASED + f"\nSELECT * FROM rebased WHERE series = '{ACCOUNT_A}'")
def cumprod_index(p):
    return p.rebased_comparison(ACCOUNT_A, REBASE_MONTH, []).filter(F.col("series") == ACCOUNT_A)


@register("rebase_to_first", oracle=QM.REBASED + f"\nSELECT * FROM rebased WHERE series <> '{ACCOUNT_A}'")
def rebase_to_first(p):
    from ledgerline.plans.queries_serving import INDICES
    return p.rebased_comparison(ACCOUNT_A, REBASE_MONTH, INDICES).filter(F.col("series") != ACCOUNT_A)


@register("prepend_base_point", oracle=QM.REBASED + f"\nSELECT * FROM rebased WHERE date = {QM.REBASE_DAY}")
def prepend_base_point(p):
    from ledgerline.plans.queries_serving import INDICES
    start = F.date_sub(F.to_date(F.lit(REBASE_MONTH + "-01")), 1)
    return p.rebased_comparison(ACCOUNT_A, REBASE_MONTH, INDICES).filter(F.col("date") == start)


# ------------------------------------------------------------------ I / J
@register("modified_dietz_portfolio", oracle="""
SELECT account_name, year_month, emv, bmv, cf, round(r, 6) AS monthly_return FROM dietz_p""")
def modified_dietz_portfolio(p):
    d = p._dietz(p.portfolio_snapshot_monthly, ["account_name"], "month_end_value_gbp", "monthly_inflows_gbp")
    return d.select("account_name", "year_month", F.col("month_end_value_gbp").alias("emv"), "bmv",
                    F.col("monthly_inflows_gbp").alias("cf"), ratio(F.col("monthly_return")).alias("monthly_return"))


def _declared(kind: str):
    def q(p):
        return run_declared(p, kind)
    q.__name__ = f"dq_{kind}"
    return q


for _kind, _key in [("unique", "assert_unique"), ("accepted_values", "assert_accepted_values"),
                    ("relationships", "assert_relationship"), ("expression_is_true", "assert_expression")]:
    catalog._SPARK[_key] = _declared(_kind)
    catalog._ORACLE[_key] = declared_sql() + f" WHERE check_name = '{_kind}'"


# The reference's one-row CTEs side by side and its CROSS JOIN of two marts are answered
# with scalar subqueries (no cross join): the question query that used one is the operator.
alias("cross_join", "q09_sharpe_vs_index")


@register("external_inflows_daily", oracle="""
SELECT account_name, inflow_date, round(inflow_today, 2) AS inflows_gbp FROM daily_inflows""")
def external_inflows_daily(p):
    return p.daily_inflows.select("account_name", "inflow_date", money(F.col("inflow_today")).alias("inflows_gbp"))

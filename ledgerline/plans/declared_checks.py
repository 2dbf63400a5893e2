"""The declared data tests of all models (J6): sources, base views, star, intermediate tables and marts.

``DECLARED`` states them as data; :func:`run_declared` runs them, all tests of a table in one pass. A key that is declared unique twice (alone and as a combination of one) is
tested once. :func:`declared_sql` gives the same tests as DuckDB SQL over the oracle's models.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import quality as Q
from ledgerline.plans.star import ALL_TYPES

INDEX_IDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@dataclass(frozen=True)
class Checks:
    table: str                                   # reported name
    model: str                                   # attribute of the portfolio, or raw.<source>
    sql: str                                     # the oracle's relation
    not_null: tuple = ()
    unique: tuple = ()                           # tuples of columns
    accepted: dict = field(default_factory=dict)       # column -> values
    accepted_from: tuple = ()                    # (column, table of the names, its column)
    related: tuple = ()                          # (column, table, its column, condition or None)
    true: tuple = ()                             # (name, SQL expression, condition or None)


# The declared tests, in the order of the models.
DECLARED = (
    Checks("transactions", "raw.transactions", "raw_transactions", ("id", "account_id", "transaction_type", "value_gbp"),
           (("id",),), {"transaction_type": ALL_TYPES},
           related=(("account_id", "accounts", "id", None), ("fund_id", "funds", "id", "fund_id IS NOT NULL"))),
    Checks("prices", "raw.prices", "raw_prices", ("fund_id", "date", "price_pence"), (("fund_id", "date"),)),
    Checks("benchmarks", "raw.benchmarks", "raw_benchmarks", ("index_id", "date", "level"), (("index_id", "date"),),
           {"index_id": INDEX_IDS}),
    Checks("accounts", "raw.accounts", "raw_accounts", ("id",), (("id",),), accepted_from=(("id", "nations", "n_name"),)),
    Checks("funds", "raw.funds", "raw_funds", ("id",), (("id",),)),
    Checks("base_transactions", "base_transactions",
           "(SELECT *, if(value_gbp < 0, 1, -1) AS unit_direction FROM base_tx)",
           ("transaction_id", "account_id", "trade_date", "transaction_type", "value_gbp", "is_trade", "is_contribution",
            "unit_direction"), (("transaction_id",),), {"transaction_type": ALL_TYPES, "unit_direction": (1, -1)}),
    Checks("base_prices", "base_prices",
           "(SELECT fund_id, date AS price_date, price_pence, price_pence / 100.0 AS price_gbp FROM raw_prices)",
           ("fund_id", "price_date", "price_pence", "price_gbp"), (("fund_id", "price_date"),)),
    Checks("base_benchmarks", "base_benchmarks",
           "(SELECT index_id, date AS market_date, level AS index_level FROM raw_benchmarks)",
           ("index_id", "market_date", "index_level"), (("index_id", "market_date"),), {"index_id": INDEX_IDS}),
    Checks("dim_account", "dim_account", "dim_account", ("account_key", "account_name", "account_open_date"),
           (("account_key",), ("account_name",)), accepted_from=(("account_name", "accounts", "id"),)),
    Checks("dim_date", "dim_date", "dim_date", ("date_key", "date", "year", "month", "day", "year_month", "financial_year"),
           (("date_key",), ("date",)),
           true=(("month_end_indicator", "month_end_indicator = 'Month End'", "date = DATE '2000-02-29'"),
                 ("financial_year_end_indicator", "financial_year_end_indicator = 'Financial Year End'",
                  "date = DATE '2001-03-31'"))),
    Checks("dim_fund", "dim_fund", "dim_fund", ("fund_key", "fund_id", "fund_name", "investment_status_indicator"),
           (("fund_key",), ("fund_id",)), {"investment_status_indicator": ("Holding", "Exited")}),
    Checks("dim_transaction_type", "dim_transaction_type", "dim_transaction_type",
           ("transaction_type_key", "transaction_type", "trade_indicator", "contribution_indicator"),
           (("transaction_type_key",), ("transaction_type", "transaction_subtype")),
           {"transaction_type": ALL_TYPES, "trade_indicator": ("Trade", "Non-Trade"),
            "contribution_indicator": ("Contribution", "Transfer", "Non-Contribution")}),
    Checks("fct_benchmarks_monthly", "fct_benchmarks_monthly", "fct_benchmarks_monthly",
           ("date_key", "index_id", "ticker", "year_month", "month_end_level"), (("index_id", "year_month"),),
           {"index_id": INDEX_IDS}, related=(("date_key", "dim_date", "date_key", None),),
           true=(("month_end_level", "month_end_level > 0", None),)),
    Checks("fct_cash_position_daily", "fct_cash_position_daily", "fct_cash_position_daily",
           ("date_key", "account_key", "trade_cash_net_gbp", "inflows_gbp", "fees_and_other_gbp", "net_cash_movement_gbp",
            "cash_balance_gbp"), (("account_key", "date_key"),),
           related=(("date_key", "dim_date", "date_key", None), ("account_key", "dim_account", "account_key", None)),
           true=(("net_cash_movement_gbp",
                  "abs(net_cash_movement_gbp - (trade_cash_net_gbp + inflows_gbp + fees_and_other_gbp)) < 0.005", None),)),
    Checks("fct_fund_prices_daily", "fct_fund_prices_daily", "fct_fund_prices_daily", ("date_key", "fund_key", "fund_price_gbp"),
           (("fund_key", "date_key"),),
           related=(("date_key", "dim_date", "date_key", None), ("fund_key", "dim_fund", "fund_key", None))),
    Checks("fct_holdings_daily", "holdings_daily", "holdings_daily", ("date_key", "account_key", "holding_type", "value_gbp"),
           (("account_key", "fund_key", "date_key", "holding_type"),), {"holding_type": ("Fund", "Cash")},
           related=(("date_key", "dim_date", "date_key", None), ("account_key", "dim_account", "account_key", None),
                    ("fund_key", "dim_fund", "fund_key", "holding_type = 'Fund'")),
           true=(("units_held", "units_held > 0", "holding_type = 'Fund'"),)),
    Checks("fct_transactions", "fct_transactions", "fct",
           ("transaction_id", "account_key", "transaction_type_key", "trade_date_key", "value_gbp"),
           (("transaction_id",),),
           related=(("account_key", "dim_account", "account_key", None),
                    ("fund_key", "dim_fund", "fund_key", "fund_key IS NOT NULL"),
                    ("transaction_type_key", "dim_transaction_type", "transaction_type_key", None),
                    ("trade_date_key", "dim_date", "date_key", None),
                    ("settle_date_key", "dim_date", "date_key", "settle_date_key IS NOT NULL"))),
    Checks("int_cash_values_daily", "cash_values_daily", "cash_values_daily", ("date_key", "account_key", "value_gbp")),
    Checks("int_fund_values_daily", "fund_values_daily", "fund_values_daily",
           ("date_key", "account_key", "fund_key", "units_held", "fund_price_gbp", "value_gbp"),
           true=(("units_held", "units_held > 0", None),)),
    Checks("mart_benchmarks_monthly", "benchmark_returns_monthly", "benchmark_returns_monthly",
           ("index_id", "year_month", "month_end_date", "month_end_level"), (("index_id", "year_month"),), {"index_id": INDEX_IDS}),
    Checks("mart_contributions_by_financial_year", "contributions_by_fy", "contributions_by_fy",
           ("account_name", "financial_year", "contributions_gbp"), (("account_name", "financial_year"),)),
    Checks("mart_fund_returns_monthly", "fund_returns_monthly", "fund_returns_monthly", ("account_name", "fund_name", "year_month"),
           (("account_name", "fund_name", "year_month"),)),
    Checks("mart_fund_snapshot_monthly", "fund_snapshot_monthly", "fund_snapshot_monthly",
           ("account_name", "fund_name", "year_month"), (("account_name", "fund_name", "year_month"),)),
    Checks("mart_holdings_latest", "holdings_latest", "holdings_latest",
           ("account_name", "holding_type", "valuation_date", "value_gbp"), (("account_name", "holding_type", "fund_name"),),
           {"holding_type": ("Fund", "Cash")}),
    Checks("mart_portfolio_inflows_daily", "portfolio_inflows_daily", "portfolio_inflows_daily",
           ("account_name", "valuation_date", "portfolio_value_gbp", "inflows_gbp", "cumulative_inflows_gbp"),
           (("account_name", "valuation_date"),)),
    Checks("mart_portfolio_returns_monthly", "portfolio_returns_monthly", "portfolio_returns_monthly",
           ("account_name", "year_month", "financial_year"), (("account_name", "year_month"),)),
    Checks("mart_portfolio_snapshot_monthly", "portfolio_snapshot_monthly", "portfolio_snapshot_monthly",
           ("account_name", "year_month", "financial_year"), (("account_name", "year_month"),)),
    Checks("mart_portfolio_value_daily", "portfolio_value_daily", "portfolio_value_daily",
           ("account_name", "valuation_date", "portfolio_value_gbp"), (("account_name", "valuation_date"),)),
)


def n_checks() -> int:
    return sum(len(c.not_null) + len(c.unique) + len(c.accepted) + len(c.accepted_from) + len(c.related) + len(c.true)
               for c in DECLARED)


# ------------------------------------------------------------------ Spark
def _parents(p) -> dict[str, DataFrame]:
    return {"accounts": p.raw.accounts, "funds": p.raw.funds, "nations": p.table("nation"), "dim_date": p.dim_date,
            "dim_account": p.dim_account, "dim_fund": p.dim_fund, "dim_transaction_type": p.dim_transaction_type}


def run_declared(p, only: str | None = None) -> DataFrame:
    """(table_name, check_name, column_name, failures) of every declared test, or of one kind of them.

    One pass a table. Tables are read as they are written; a model that isn't written yet is taken from its
    definition, so a check builds no other mart than the one it names.
    """
    parents, out = _parents(p), []
    wants = lambda kind: only in (None, kind)
    for c in DECLARED:
        checks = {
            "not_null": c.not_null if wants("not_null") else (),
            "accepted": c.accepted if wants("accepted_values") else {},
            "expressions": [(name, F.expr(e), None if w is None else F.expr(w)) for name, e, w in c.true]
            if wants("expression_is_true") else [],
            "unique": [cols for cols in c.unique if wants("unique" if len(cols) == 1 else "unique_combination")],
            "related": [("relationships", col, parents[t], pc, None if w is None else F.expr(w)) for col, t, pc, w in c.related
                        if wants("relationships")]
            + [("accepted_values", col, parents[t], pc, None) for col, t, pc in c.accepted_from if wants("accepted_values")]}
        if any(checks.values()):
            df = getattr(p.raw, c.model[4:]) if c.model.startswith("raw.") else getattr(p, c.model)
            out.append(Q.grouped_checks(df, c.table, **checks))
    return reduce(DataFrame.unionByName, out)


# ------------------------------------------------------------------ DuckDB
_RELATIONS = {"accounts": "raw_accounts", "funds": "raw_funds", "nations": "nation"}


def _count(c: Checks, check: str, column: str, condition: str) -> str:
    return f"SELECT '{c.table}', '{check}', '{column}', count(*) FILTER (WHERE {condition}) FROM {c.sql}"


def _orphans(c: Checks, check: str, col: str, table: str, parent_col: str, where: str | None) -> str:
    parent = _RELATIONS.get(table, table)
    return (f"SELECT '{c.table}', '{check}', '{col}', count(*) FROM {c.sql} child WHERE child.{col} IS NOT NULL "
            f"AND ({where or 'TRUE'}) AND child.{col} NOT IN (SELECT {parent_col} FROM {parent} WHERE {parent_col} IS NOT NULL)")


def declared_sql() -> str:
    rows = []
    for c in DECLARED:
        rows += [_count(c, "not_null", x, f"{x} IS NULL") for x in c.not_null]
        for x, values in c.accepted.items():
            listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
            rows.append(_count(c, "accepted_values", x, f"{x} NOT IN ({listed})"))
        rows += [_count(c, "expression_is_true", name, f"({w or 'TRUE'}) AND ({e}) IS NOT TRUE") for name, e, w in c.true]
        for cols in c.unique:
            name, keys = "unique" if len(cols) == 1 else "unique_combination", ", ".join(cols)
            rows.append(f"SELECT '{c.table}', '{name}', '{','.join(cols)}', count(*) FROM "
                        f"(SELECT {keys} FROM {c.sql} GROUP BY {keys} HAVING count(*) > 1)")
        rows += [_orphans(c, "relationships", *r) for r in c.related]
        rows += [_orphans(c, "accepted_values", *r, None) for r in c.accepted_from]
    return ", dq(table_name, check_name, column_name, failures) AS (\n" + "\nUNION ALL ".join(rows) + ")\nSELECT * FROM dq"

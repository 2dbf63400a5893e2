"""The reference API tests' golden values, over the same hand-seeded marts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.windows import period_end_downsample
from ledgerline.sources.fixture import RawSources
from tests.conftest import seeded_portfolio

D = dt.date


@pytest.fixture(scope="module")
def seeded(spark):
    value_daily = spark.createDataFrame(
        [("ISA", D(2024, 1, 31), 10000.0), ("SIPP", D(2024, 1, 31), 5000.0),
         ("ISA", D(2024, 2, 29), 10500.0), ("SIPP", D(2024, 2, 29), 5200.0)],
        "account_name string, valuation_date date, portfolio_value_gbp double")
    inflows = spark.createDataFrame(
        [("ISA", D(2024, 1, 31), 10000.0, 0.0, 8000.0), ("SIPP", D(2024, 1, 31), 5000.0, 0.0, 4500.0),
         ("ISA", D(2024, 2, 29), 10500.0, 0.0, 8500.0), ("SIPP", D(2024, 2, 29), 5200.0, 0.0, 4700.0)],
        "account_name string, valuation_date date, portfolio_value_gbp double, inflows_gbp double, "
        "cumulative_inflows_gbp double")
    contrib = spark.createDataFrame(
        [("ISA", "2023/24", 5000.0), ("SIPP", "2023/24", 3000.0), ("ISA", "2024/25", 2000.0),
         ("SIPP", "2024/25", 1500.0)], "account_name string, financial_year string, contributions_gbp double")
    returns = spark.createDataFrame(
        [("ISA", "2024-01", D(2024, 1, 31), 0.01, 9900.0, 0.0, 0.5, 0.4),
         ("SIPP", "2024-01", D(2024, 1, 31), 0.015, 4900.0, 0.0, 0.4, 0.3),
         ("ISA", "2024-02", D(2024, 2, 29), 0.02, 10000.0, 100.0, 0.6, None),
         ("SIPP", "2024-02", D(2024, 2, 29), 0.01, 5000.0, 50.0, 0.5, None)],
        "account_name string, year_month string, month_end_date date, monthly_return double, "
        "prev_month_end_value_gbp double, month_inflows_gbp double, trailing_12m_sharpe double, "
        "trailing_36m_sharpe double")
    bench = spark.createDataFrame(
        [("FTSE100", D(2024, 1, 31), 7500.0, "2024-01", 0.30, 0.25), ("FTSE100", D(2024, 2, 29), 7600.0, "2024-02", 0.35, None),
         ("SP500", D(2024, 1, 31), 4800.0, "2024-01", 0.50, 0.40), ("SP500", D(2024, 2, 29), 4900.0, "2024-02", 0.55, None),
         ("NASDAQ", D(2024, 1, 31), 15000.0, "2024-01", 0.60, 0.50), ("NASDAQ", D(2024, 2, 29), 15500.0, "2024-02", 0.65, None)],
        "index_id string, month_end_date date, month_end_level double, year_month string, "
        "trailing_12m_sharpe double, trailing_36m_sharpe double")
    dim_fund = spark.createDataFrame(
        [("F1", "FUND_A", "Fund Alpha", "Alpha", "MS001", D(2020, 1, 1), None, "Holding"),
         ("F2", "FUND_B", "Fund Beta", "Beta", "MS002", D(2019, 1, 1), D(2023, 5, 1), "Exited")],
        "fund_key string, fund_id string, fund_name string, fund_short_name string, morningstar_code string, "
        "first_investment_date date, last_position_date date, investment_status_indicator string")
    # sparse steps equivalent to the seeded daily holdings: ISA holds FUND_A (100 then 105 units)
    unit_iv = spark.createDataFrame(
        [("A1", "ISA", "F1", "FUND_A", D(2024, 1, 31), D(2024, 2, 28), 100.0, D(2024, 1, 31)),
         ("A1", "ISA", "F1", "FUND_A", D(2024, 2, 29), D(2024, 2, 29), 105.0, D(2024, 1, 31)),
         ("A2", "SIPP", "F1", "FUND_A", D(2024, 1, 31), D(2024, 2, 29), 52.0, D(2024, 1, 31))],
        "account_key string, account_name string, fund_key string, fund_id string, u0 date, u1 date, "
        "units_held double, fp date")
    prices = spark.createDataFrame([("F1", D(2024, 1, 31), 50.0), ("F1", D(2024, 2, 29), 52.0)],
                                   "fund_key string, price_date date, fund_price_gbp double")
    cash = spark.createDataFrame([("A1", "ISA", D(2024, 2, 29), 500.0), ("A2", "SIPP", D(2024, 2, 29), 250.0)],
                                 "account_key string, account_name string, trade_date date, cash_balance_gbp double")
    month_end = spark.createDataFrame(
        [(D(2024, 1, 31), "Fund", "FUND_A", 50.0), (D(2024, 2, 29), "Fund", "FUND_A", 52.0)],
        "date date, holding_type string, fund_id string, fund_price_gbp double")
    txlog = spark.createDataFrame(
        [("TX001", "ISA", "FUND_A", D(2024, 1, 31), "BUY", 10.0, -500.0),
         ("TX002", "SIPP", None, D(2024, 1, 31), "CONTRIBUTION", None, 100.0),
         ("TX003", "ISA", "FUND_A", D(2024, 2, 29), "SELL", 5.0, 250.0)],
        "id string, account_id string, fund_id string, trade_date date, transaction_type string, "
        "quantity double, value_gbp double")
    log = spark.createDataFrame([(dt.datetime(2024, 2, 29, 10), "transactions", 10, "success", None),
                                 (dt.datetime(2024, 2, 29, 11), "prices", 5, "success", None)],
                                "run_at timestamp, source string, rows_inserted int, status string, detail string")
    raw = RawSources(None, None,
                     spark.createDataFrame([(D(2024, 2, 15),)], "trade_date date"),
                     spark.createDataFrame([(D(2024, 2, 29),)], "date date"), None, log)
    return seeded_portfolio(
        spark, raw=raw, portfolio_value_daily=value_daily, portfolio_inflows_daily=inflows,
        contributions_by_fy=contrib, portfolio_returns_monthly=returns, benchmark_returns_monthly=bench,
        dim_fund=dim_fund, unit_intervals=unit_iv, price_steps=prices, cash_steps=cash,
        holdings_month_end=month_end, transaction_log_rows=txlog)


def test_value_series(seeded):
    rows = seeded.portfolio_value_series("2017-01-01", "2024-12-31").orderBy("date").collect()
    assert len(rows) == 2 and rows[0].date == D(2024, 1, 31) and rows[0].value_gbp == 15000.0
    isa = {r.value_gbp for r in seeded.portfolio_value_series("2017-01-01", "2024-12-31", "ISA").collect()}
    assert isa == {10000.0, 10500.0}
    late = seeded.portfolio_value_series("2024-02-01", "2024-12-31").collect()
    assert [r.date for r in late] == [D(2024, 2, 29)]


def test_allocation(seeded):
    rows = seeded.allocation_as_of().collect()
    assert [(r.fund_id, r.percentage) for r in rows] == [("FUND_A", 100.0)]
    assert rows[0].units_held == 157.0 and rows[0].price_gbp == 52.0
    sipp = seeded.allocation_as_of(account="SIPP").collect()
    assert [r.fund_id for r in sipp] == ["FUND_A"]


def test_contributions_pivot(seeded):
    rows = seeded.contributions_fy_pivot(["ISA", "SIPP"]).orderBy("financial_year").collect()
    assert (rows[0].financial_year, rows[0].isa_gbp, rows[0].sipp_gbp, rows[0].total_gbp) == \
        ("2023/24", 5000.0, 3000.0, 8000.0)


def test_performance_index(seeded):
    rows = seeded.performance_index("2017-01-01", "2024-12-31").orderBy("date").collect()
    assert len(rows) == 2 and rows[0].indexed == 100.0
    # Feb weighted return: (0.02*10050 + 0.01*5025) / 15075
    r = (0.02 * 10050 + 0.01 * 5025) / 15075
    assert rows[1].indexed == round(100.0 * (1 + r), 4)


def test_latest_sharpe(seeded):
    got = {r.series: (r.trailing_12m, r.trailing_36m) for r in seeded.latest_sharpe("2024-12-31").collect()}
    assert got["portfolio"][0] == pytest.approx((0.6 * 10000 + 0.5 * 5000) / 15000)
    assert got["portfolio"][1] is None
    assert got["FTSE100"] == (0.35, None)


def test_fund_performance(seeded):
    rows = seeded.fund_performance("FUND_A", None, "2024-12-31", ["FTSE100", "SP500", "NASDAQ"]).collect()
    fund = sorted((r.date, r.indexed) for r in rows if r.series == "FUND_A")
    assert fund[0][1] == 100.0 and fund[1][1] == pytest.approx(104.0)
    ftse = sorted((r.date, r.indexed) for r in rows if r.series == "FTSE100")
    assert ftse[0][1] == 100.0
    assert seeded.fund_performance("NOPE", None, "2024-12-31").count() == 0


def test_list_funds(seeded):
    assert seeded.list_funds().count() == 2
    assert [r.fund_id for r in seeded.list_funds(active_only=True).collect()] == ["FUND_A"]


def test_transaction_page(seeded):
    assert seeded.transaction_filter().count() == 3
    assert seeded.transaction_page(page=2, per_page=2).count() == 1
    assert seeded.transaction_filter(account="ISA").count() == 2
    assert seeded.transaction_filter(tx_type="buy").count() == 1
    assert seeded.transaction_filter(date_from="2024-02-01", date_to="2024-02-29").count() == 1
    assert seeded.transaction_filter(tx_type="BOGUS").count() == 3
    first = seeded.transaction_page(page=1, per_page=2).collect()
    assert [r.id for r in first] == ["TX003", "TX001"]
    after = seeded.transaction_page_after(str(first[-1].trade_date), first[-1].id, per_page=2).collect()
    assert [r.id for r in after] == ["TX002"]
    with pytest.raises(ValueError):
        seeded.transaction_page(per_page=201)


def test_ingest_log_summary(seeded):
    rows = {r.source: r for r in seeded.ingest_log_summary.collect()}
    assert set(rows) == {"transactions", "prices"}
    assert rows["transactions"].latest_data_date == D(2024, 2, 15)
    assert rows["prices"].last_rows_imported_at == dt.datetime(2024, 2, 29, 11)


def test_period_end_downsample(spark):
    empty = spark.createDataFrame([], "series string, date date, v double")
    assert period_end_downsample(empty, ["series"], "date").count() == 0
    twelve = spark.createDataFrame([("s", D(2024, m, 1), float(m)) for m in range(1, 13)], "series string, date date, v double")
    assert period_end_downsample(twelve, ["series"], "date").count() == 12
    jan = spark.createDataFrame([("s", D(2024, 1, 5), 1.0), ("s", D(2024, 1, 20), 2.0)], "series string, date date, v double")
    assert [r.v for r in period_end_downsample(jan, ["series"], "date").collect()] == [2.0]


def test_adhoc_select_rejects_writes(seeded):
    with pytest.raises(ValueError):
        seeded.adhoc_select("DROP TABLE x")
    assert F is not None

"""Incremental refresh against full builds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.incremental import HOLDINGS, MARTS, SNAPSHOT, VALUES, Landing, MartStore
from ledgerline.plans.portfolio import Portfolio
from ledgerline.sources.fixture import load_raw
from tests.conftest import SMOKE_DIR

CALENDAR = {"calendar_start": "1992-01-01", "calendar_end": "2001-12-31"}


def _rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def _full(spark, raw, as_of):
    p = Portfolio(spark, raw, as_of=as_of, **CALENDAR)
    return {HOLDINGS: p.holdings_daily, VALUES: p.portfolio_value_daily, SNAPSHOT: p.portfolio_snapshot_monthly}


def test_a_late_trade_rewrites_its_month_and_later_ones(spark, tmp_path, monkeypatch):
    raw = load_raw(spark, SMOKE_DIR)
    t = raw.transactions
    one = t.agg(F.min("account_id")).first()[0]
    some = [r.id for r in t.filter(F.col("account_id") == one).orderBy("trade_date", "id").limit(200).collect()]
    t = t.filter(F.col("id").isin(some))
    late = t.orderBy(F.desc("trade_date"), "id").limit(1).first()
    landing, store = Landing(spark, f"{tmp_path}/landed"), MartStore(spark, f"{tmp_path}/marts")
    landing.land("prices", raw.prices)
    landing.land("transactions", t.filter(F.col("id") != late.id))
    one = store.refresh(landing, raw, "2001-06-10", **CALENDAR)
    assert store.refresh(landing, raw, "2001-06-10", **CALENDAR) == one              # nothing landed: nothing done
    landing.land("transactions", t.filter(F.col("id") == late.id))

    # a refresh that dies before its manifest leaves the marts as they were
    with monkeypatch.context() as m:
        m.setattr(store.versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.refresh(landing, raw, "2001-06-10", **CALENDAR)
    assert store.current() == one

    two = store.refresh(landing, raw, "2001-06-10", **CALENDAR)
    month = f"{late.trade_date:%Y-%m}"
    assert two["from"] == month
    for name in MARTS:
        versions = two["marts"][name]["months"]
        assert {m for m, v in versions.items() if v == 2} == {m for m in versions if m >= month} and min(versions) < month
    whole = landing.sources(raw)
    for name, df in _full(spark, whole, "2001-06-10").items():
        assert _rows(store.read(name)) == _rows(df), name

    # days go on: only the months that were open then
    three = store.refresh(landing, raw, "2001-07-05", **CALENDAR)
    assert three["from"] == "2001-06" or three["from"] == "2001-05"
    for name, df in _full(spark, whole, "2001-07-05").items():
        assert _rows(store.read(name)) == _rows(df), name
    with pytest.raises(ValueError):
        store.refresh(landing, raw, "2001-07-01", **CALENDAR)


def test_changes_read_new_batches_only(spark, tmp_path):
    landing = Landing(spark, str(tmp_path))
    assert landing.changes({}) == (None, {"transactions": -1, "prices": -1})
    day = lambda d: spark.createDataFrame([(dt.date(2000, 1, d),)], "date date")
    landing.land("prices", day(5))
    landing.land("prices", day(3))
    assert landing.changes({}) == (dt.date(2000, 1, 3), {"transactions": -1, "prices": 1})
    assert landing.changes({"prices": 0})[0] == dt.date(2000, 1, 3) and landing.changes({"prices": 1})[0] is None


def test_landed_sources_are_not_copied_and_large_models_are_not_sorted(spark, monkeypatch):
    from ledgerline.plans.portfolio import CORE_MODELS
    assert dict(CORE_MODELS)["fct_transactions_wide"] == []
    raw, written = load_raw(spark, SMOKE_DIR), {}
    p = Portfolio(spark, raw, as_of="2001-06-10", **CALENDAR)
    monkeypatch.setattr(p, "_write_read", lambda df, name, sort_by: written.setdefault(name, df))
    p.materialise_core(landed=["transactions", "prices"], without=["transaction_id"])
    assert "raw_transactions" not in written and "raw_prices" not in written and "raw_accounts" in written
    assert "transaction_id" not in written["fct_transactions_wide"].columns


def test_month_end_values_by_account_move_only_the_sparse_steps(spark):
    p = Portfolio(spark, load_raw(spark, SMOKE_DIR, "customer"), as_of="2001-06-10", **CALENDAR).materialise_core()
    plan = p._account_month_ends()._jdf.queryExecution().executedPlan().toString()
    dense = plan[:plan.index("Generate explode")]
    assert "SortMergeJoin" not in dense and "BroadcastHashJoin" in dense
    whole = p.holdings_month_end.groupBy("account_name", "date").agg({"value_gbp": "sum"})
    near = lambda df: {(r[0], r[1]): round(r[2], 4) for r in df.collect()}
    assert near(p._account_month_ends()) == near(whole)

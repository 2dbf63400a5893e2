"""What queries leave on disk: tables land when they are read, shuffle files and scratch go, dense rows don't move."""

import datetime as dt
import glob
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.portfolio import CORE_MODELS, Portfolio, PortfolioOnRead
from ledgerline.sources import broker_csv as B
from ledgerline.sources import records as R
from ledgerline.sources import writers as W
from ledgerline.sources.bucketed import BucketedTable
from ledgerline.sources.fixture import RawSources

TX = ("id string, account_id string, fund_id string, trade_date date, settle_date date, reference string, raw_description string, "
      "transaction_type string, transaction_subtype string, unit_cost_pence double, quantity double, value_gbp double")


def _tx(spark):
    day = lambda m, d: dt.date(2000, m, d)
    return spark.createDataFrame([
        ("1", "A", None, day(1, 3), None, "FPC", "Cash in", "CONTRIBUTION", "One-off", None, None, 1000.0),
        ("2", "A", "F1", day(1, 10), day(1, 12), "B1", "Fund One (GBP) x", "BUY", None, None, 10.0, -500.0),
        ("3", "A", "F1", day(3, 20), day(3, 22), "S1", "Fund One (GBP) x", "SELL", None, None, 10.0, 700.0),
        ("4", "B", "F9", day(2, 1), day(2, 2), "B2", "Fund Nine (GBP) x", "BUY", None, None, 5.0, -50.0)], TX)


def _raw(spark, accounts=("A", "A", "B")):
    return RawSources(
        accounts=spark.createDataFrame([(a, a) for a in accounts], "id string, name string"),
        funds=spark.createDataFrame([("F1", "Fund One", None, None, "GBP", "One", True)],
                                    "id string, name string, isin string, morningstar_code string, currency string, short_name string, is_active boolean"),
        transactions=_tx(spark),
        prices=spark.createDataFrame([("F1", dt.date(2000, 1, 15), 6000.0, "x")], "fund_id string, date date, price_pence double, source string"),
        benchmarks=spark.createDataFrame([("I", dt.date(2000, 1, 31), 1.0, "^I")], "index_id string, date date, level double, ticker string"),
        ingest_log=spark.createDataFrame([(dt.datetime(2000, 1, 1), "prices", 1, "success", "x")],
                                         "run_at timestamp, source string, rows_inserted int, status string, detail string"))


CALENDAR = {"as_of": "2000-05-10", "calendar_start": "2000-01-01", "calendar_end": "2000-12-31"}


def test_tables_land_when_they_are_read_and_once(spark, monkeypatch):
    written = []
    real = Portfolio._write_read

    def write_read(self, df, name, sort_by):
        written.append(name)
        time.sleep(0.2)
        return real(self, df, name, sort_by)
    monkeypatch.setattr(Portfolio, "_write_read", write_read)
    p = PortfolioOnRead(spark, _raw(spark), **CALENDAR)
    assert written == []
    with ThreadPoolExecutor(4) as pool:
        assert {df.count() for df in pool.map(lambda _: p.raw.transactions, range(4))} == {4}
    assert written == ["raw_transactions"]
    assert p.unit_steps.count() == p.unit_steps.count() > 0
    assert sorted(written) == sorted({*written}) and "raw_benchmarks" not in written and "fct_cash_position_daily" not in written
    p.materialise_core()
    assert sorted(written) == sorted([n for n, _ in CORE_MODELS] + [f"raw_{n}" for n in p.raw._raw.__dataclass_fields__])
    with pytest.raises(AttributeError):
        p.raw.nothing


def test_snapshots_move_no_dense_row_and_keep_repeated_accounts(spark):
    p = Portfolio(spark, _raw(spark), **CALENDAR)
    snapshot = p.portfolio_snapshot_monthly
    plan = snapshot._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    dense = plan[:plan.index("Generate explode")]
    assert "Exchange" not in dense
    got = sorted((r.account_name, r.year_month, r.month_end_value_gbp, r.monthly_inflows_gbp, r.monthly_net_fund_purchases_gbp)
                 for r in snapshot.collect())
    # every transaction of the account listed twice counts twice, and so do its rows; F9 is no known fund
    a = [("A", "2000-01", 2200.0, 2000.0, 1000.0), ("A", "2000-02", 2200.0, 0.0, 0.0),
         ("A", "2000-03", 2400.0, 0.0, -1400.0), ("A", "2000-04", 2400.0, 0.0, 0.0)]
    b = [("B", "2000-02", -50.0, 0.0, 50.0), ("B", "2000-03", -50.0, 0.0, 0.0), ("B", "2000-04", -50.0, 0.0, 0.0)]
    assert got == sorted(a + a + b)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_scratch_write_leaves_no_shuffle_files(spark, tmp_path):
    before = _shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    W.write_scratch(df, f"{tmp_path}/t")
    until = time.time() + 20
    while _shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before and spark.read.parquet(f"{tmp_path}/t").count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert glob.glob(f"{tmp_path}/t/*.zstd.parquet")


def test_the_raw_line_is_kept_where_it_is_reported(spark, tmp_path):
    (tmp_path / "ACC").mkdir()
    (tmp_path / "ACC" / "a.csv").write_text("Trade date,Reference,Description,Value\n01/02/2020,B1,Fund A (GBP) x,5\n"
                                            "01/02/2020,B2,Other (GBP) x,6\n01/02/2020,B3,Fund A (GBP) x,bad\n")
    funds = spark.createDataFrame([("F1", "Fund A")], "id string, name string")
    matched = B.match_parsed(B.parse_broker_rows(B.scan_broker_csv(spark, str(tmp_path))), funds)
    assert {r.reference: r.raw_line for r in matched.collect()} == {
        "B1": None, "B2": "01/02/2020,B2,Other (GBP) x,6", "B3": "01/02/2020,B3,Fund A (GBP) x,bad"}


def test_readers_of_keys_alone_shuffle_nothing_else(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), ("b", 2, "z")], "id string, n int, t string")
    first = W.dedupe_first(df, ["id"], ["n"])
    assert first.columns == df.columns and sorted(map(tuple, first.collect())) == [("a", None, "y"), ("b", 2, "z")]
    assert "min_by" not in first.select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert W.dedupe_first(df.select("id"), ["id"], []).count() == 2


def test_a_batch_is_dealt_to_the_buckets_once(spark, tmp_path):
    schema = "id string, day string, v int"
    table = BucketedTable(spark, f"{tmp_path}/t", spark.createDataFrame([], schema).schema, ["id"], 4)
    table.insert_or_ignore(spark.createDataFrame([("a", "1", 1)], schema))
    new = table.new_rows(spark.createDataFrame([("a", "2", 2), ("b", "2", 3), ("b", "1", 4)], schema), ["day"])
    plan = new._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1, plan
    assert [tuple(r) for r in new.collect()] == [("b", "1", 4)]


def test_packed_exports_hold_the_same_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FILE_ROWS", 2)
    tx = _tx(spark).coalesce(1)
    rows = {}
    for packed in (True, False):
        root = B.write_broker_csv(tx, f"{tmp_path}/{packed}", packed)
        rows[packed] = sorted(map(str, B.parse_broker_rows(B.scan_broker_csv(spark, root)).drop("source_file").collect()))
    assert len(rows[True]) == 4 and rows[True] == rows[False]
    files = [len(f) for _, _, f in os.walk(f"{tmp_path}/True/account=A")]
    assert len(glob.glob(f"{tmp_path}/True/account=A/*.csv.gz")) == 2 and files and not glob.glob(f"{tmp_path}/True/*/*.csv")


def test_stitching_leaves_one_scratch_table(spark, tmp_path):
    (tmp_path / "ACC").mkdir()
    (tmp_path / "ACC" / "a.csv").write_text('Trade date,Reference,Description,Value\n01/02/2020,B1,"one\ntwo\n\nthree",5\n01/02/2020,B2,plain,6\n')
    lines = B.read_lines(spark, str(tmp_path))
    headers = B.file_headers(lines).select("source_file", "header_pos")
    kept = W.checkpoint_dir(spark).removeprefix("file:")
    before = {*os.listdir(kept)}
    got = sorted((r.line, r.unclosed) for r in R.stitched(lines.join(headers, "source_file")).collect())
    assert got == [('01/02/2020,B1,"one\ntwo\n\nthree",5', False), ("01/02/2020,B2,plain,6", False), ("Trade date,Reference,Description,Value", False)]
    assert [n.rpartition("-")[0] for n in {*os.listdir(kept)} - before] == ["record-parts"]


def test_a_stream_batch_drops_its_parsed_rows(spark, tmp_path):
    from ledgerline.streaming.drop_folder import read_report, read_target, start_drop_folder_ingest
    (tmp_path / "drop" / "ACC").mkdir(parents=True)
    (tmp_path / "drop" / "ACC" / "a.csv").write_text("Trade date,Reference,Description,Value\n01/02/2020,B1,Fund A (GBP) x,5\n"
                                                     "01/02/2020,B3,Fund A (GBP) x,bad\n")
    kept = W.checkpoint_dir(spark).removeprefix("file:")
    before = {*os.listdir(kept)}
    funds = spark.createDataFrame([("F1", "Fund A")], "id string, name string")
    start_drop_folder_ingest(spark, f"{tmp_path}/drop", f"{tmp_path}/tx", f"{tmp_path}/ckpt", funds).awaitTermination()
    assert not [n for n in {*os.listdir(kept)} - before if n.startswith("parsed-batch")]
    assert [r.fund_id for r in read_target(spark, f"{tmp_path}/tx").collect()] == ["F1"]
    assert [r.raw_line for r in read_report(spark, f"{tmp_path}/tx", "rejects").collect()] == ["01/02/2020,B3,Fund A (GBP) x,bad"]

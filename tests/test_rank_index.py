"""Rank index of the transaction log (F1, D16) and footer statistics of landed prices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.rank_index import RankIndex
from ledgerline.sources import feeds as FD


def _log(spark, n=3_000):
    rnd = random.Random(1)
    rows = [(f"t{k:05d}", rnd.choice("AAAAAB"), dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 200)), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id string, account_id string, trade_date date, v long")


@pytest.mark.parametrize("group", [None, "account_id"])
def test_pages_equal_a_sorted_list(spark, tmp_path, group):
    rows, df = _log(spark)
    index = RankIndex(spark, f"{tmp_path}/i", group).build(df, parts=12)
    for value in ("A", "B", "none") if group else (None,):
        want = sorted((r for r in rows if value in (None, r[1])), key=lambda r: (-r[2].toordinal(), r[0]))
        assert index.total(value) == len(want)
        for page, per_page in ((1, 50), (2, 50), (9, 200), (len(want) // 50 + 1, 50), (1000, 50), (7, 33)):
            got = index.page(page, per_page, value)
            assert [r.id for r in got.collect()] == [r[0] for r in want[(page - 1) * per_page:page * per_page]]
            assert {r.total for r in got.collect()} <= {len(want)}
            # a page reads the parts that hold it, two at most
            assert not want or page > 30 or len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) <= 2
    with pytest.raises(ValueError):
        index.page(0)


def test_last_days_come_from_footers(spark, tmp_path):
    rows = [(f, dt.date(2000, 1, 1) + dt.timedelta(days=k * (i + 1)), float(k)) for i, f in enumerate("abc") for k in range(50)]
    prices = spark.createDataFrame(rows, "fund_id string, date date, price_pence double")
    root = FD.land_by_fund(prices, f"{tmp_path}/p")
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    got = {r.fund_id: r._last for r in FD.last_days(spark, root).collect()}
    assert got == {r.fund_id: r.m for r in prices.groupBy("fund_id").agg(F.max("date").alias("m")).collect()}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    for k, v in {"spark.sql.sources.useV1SourceList": "csv", "spark.sql.parquet.aggregatePushdown": "true"}.items():
        spark.conf.set(k, v)
    try:
        plan = FD.last_day_query(spark, root)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "false")
    assert "PushedAggregation: [MAX(date)]" in plan and "PushedGroupBy: [fund_id]" in plan

"""The daily model build: core tables, then every mart written as a table (A20, section 3 entry 1).

``daily_refresh`` is what the reference's nightly model build produces: the
star and the marts as tables that reports and ad-hoc SQL read. Writes go to
the session's ``spark.checkpoint.dir`` (shared storage on a cluster), one
fresh run folder per refresh. The dense daily holdings table is partitioned
by month, so date-range readers prune to the months they need; the other
marts are small per entity and written unpartitioned, sorted by entity.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.portfolio import PortfolioOnRead
from ledgerline.sources.writers import SCRATCH_CODEC, shuffles_removed

# Mart tables of one refresh: name -> (Portfolio attribute, partition column or None, sort columns).
MART_TABLES = {
    "fct_holdings_daily": ("holdings_daily", "year_month", ["account_key", "date"]),
    "mart_portfolio_value_daily": ("portfolio_value_daily", None, ["account_name", "valuation_date"]),
    "mart_portfolio_inflows_daily": ("portfolio_inflows_daily", None, ["account_name", "valuation_date"]),
    "mart_portfolio_snapshot_monthly": ("portfolio_snapshot_monthly", None, ["account_name", "year_month"]),
    "mart_fund_snapshot_monthly": ("fund_snapshot_monthly", None, ["account_name", "fund_name", "year_month"]),
    "mart_portfolio_returns_monthly": ("portfolio_returns_monthly", None, ["account_name", "year_month"]),
    "mart_fund_returns_monthly": ("fund_returns_monthly", None, ["account_name", "fund_name", "year_month"]),
    "mart_benchmarks_monthly": ("benchmark_returns_monthly", None, ["index_id", "year_month"]),
    "mart_holdings_latest": ("holdings_latest", None, ["account_name"]),
    "mart_contributions_by_financial_year": ("contributions_by_fy", None, ["account_name", "financial_year"]),
}


def refresh_tables(portfolio) -> dict[str, DataFrame]:
    """Write the core models and every mart, once per model set, and let the models read the written tables.

    The marts are independent of each other once the core is written, so they
    are submitted as concurrent Spark jobs.
    """
    p = portfolio if portfolio.materialised else portfolio.materialise_core()
    if hasattr(p, "_marts"):
        return p._marts
    if isinstance(p, PortfolioOnRead):       # the star first, as a whole: its tables are written concurrently
        p.materialise_core()

    def write(name: str) -> DataFrame:
        attr, part, sort_by = MART_TABLES[name]
        df = getattr(p, attr)
        columns = df.columns
        if part == "year_month":
            df = df.withColumn(part, F.date_format("date", "yyyy-MM"))
        path = f"{p._table_root()}/marts/{name}"
        # range-partition on (month, entity): balanced tasks, each spanning few month folders
        out = df.repartitionByRange(part, sort_by[0]) if part else df
        writer = out.sortWithinPartitions(*sort_by).write.mode("overwrite").option("compression", SCRATCH_CODEC)
        (writer.partitionBy(part) if part else writer).parquet(path)
        return p.spark.read.parquet(path).select(*columns)

    sc = p.spark.sparkContext
    group = sc.getLocalProperty("spark.jobGroup.id")

    def run(name):
        if group:
            sc.setJobGroup(group, group)
        return name, write(name)
    with shuffles_removed(p.spark), ThreadPoolExecutor(max_workers=4) as pool:
        p._marts = dict(pool.map(run, MART_TABLES))
    for name, (attr, _, _) in MART_TABLES.items():      # reports built from now on read the tables
        p.__dict__[attr] = p._marts[name]
        p.materialised.add(attr)
    return p._marts


def daily_refresh(portfolio) -> DataFrame:
    """The nightly build; (model, rows) read back from the written tables."""
    tables = refresh_tables(portfolio)
    counts = [tables[n].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("model"), "row_count")
              for n in MART_TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out

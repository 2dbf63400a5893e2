"""Incremental refresh of the dense marts (A20, the daily build).

Sources land in batches (``sources/commits.py``). A refresh asks which batches have landed since its high-water marks, takes the
earliest date in them and rebuilds only the months from there on: a trade or price of some day changes units, cash and
values of that day and later ones, never of earlier ones. Months are immutable folders of the version that wrote them; a
manifest per version says which folder holds each month, and the newest manifest is the current state, put in place by
one rename. A refresh that dies leaves the current state as it was and is repeated in full.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.portfolio import Portfolio
from ledgerline.sources.commits import BatchTable, Manifests
from ledgerline.sources.fixture import RawSources

HOLDINGS, VALUES, SNAPSHOT = "fct_holdings_daily", "mart_portfolio_value_daily", "mart_portfolio_snapshot_monthly"
# Mart -> (column that tells the month, column to sort by).
MARTS = {HOLDINGS: ("date", "account_key"), VALUES: ("valuation_date", "account_name"), SNAPSHOT: ("year_month", "account_name")}
MONTH = "_month"
UNREAD = ("transaction_id", "transaction_reference", "transaction_full_description", "transaction_type_key", "trade_date_key",
          "settle_date_key", "settle_date", "transaction_subtype")       # of the fact, by these marts
DATED = {"transactions": "trade_date", "prices": "date"}       # landed sources and their dates


class Landing:
    """Transactions and prices landed batch by batch; the other sources are reference data taken as they are."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables = {name: BatchTable(spark, f"{root.rstrip('/')}/{name}") for name in DATED}

    def land(self, name: str, rows: DataFrame) -> int:
        return self.tables[name].append(rows)

    def sources(self, reference: RawSources) -> RawSources:
        own = {name: table.read() for name, table in self.tables.items()}
        fields = {f: getattr(reference, f) for f in ("accounts", "funds", "transactions", "prices", "benchmarks", "ingest_log")}
        return RawSources(**(fields | {k: v for k, v in own.items() if v is not None}))

    def changes(self, marks: dict[str, int]) -> tuple[_dt.date | None, dict[str, int]]:
        """(earliest date in batches above the marks, the marks behind them); only those batches are read."""
        dates, reached = [], {}
        for name, table in self.tables.items():
            done = sorted(table.committed())
            reached[name] = done[-1] if done else -1
            new = [b for b in done if b > marks.get(name, -1)]
            if new:
                dates.append(table.read_batches(new).agg(F.min(DATED[name])).first()[0])
        return min(filter(None, dates), default=None), reached


class MartStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Manifests(spark, f"{self.root}/_versions")

    def current(self) -> dict | None:
        """The newest manifest: version, marks, horizon, and for each mart its columns and the version of every month."""
        found = self.versions.read_all()
        return found[max(found)] if found else None

    def read(self, mart: str) -> DataFrame:
        state = self.current()["marts"][mart]
        folders = [f"{self.root}/{mart}/version={v}/{MONTH}={m}" for m, v in sorted(state["months"].items())]
        if not folders:
            return self.spark.createDataFrame([], state["columns"])
        return self.spark.read.schema(state["columns"]).parquet(*folders)

    def refresh(self, landing: Landing, reference: RawSources, as_of: str, **calendar) -> dict:
        """Bring all marts up to what has landed; the manifest that is current then."""
        before = self.current()
        changed, marks = landing.changes(before["marks"] if before else {})
        if before and changed is None and before["as_of"] == as_of:
            return before
        if before and as_of < before["as_of"]:
            raise ValueError(f"the marts already stand at {before['as_of']}")
        p = Portfolio(self.spark, landing.sources(reference), as_of=as_of, **calendar)
        start = self._start(before, changed, p)
        version = (before["version"] if before else 0) + 1
        marts = {name: {"columns": None, "months": {m: v for m, v in (before["marts"][name]["months"] if before else {}).items()
                                                    if m < f"{start:%Y-%m}"}} for name in MARTS}
        if f"{start}" <= p.horizon:
            p.materialise_core(landed=[n for n, t in landing.tables.items() if t.committed()], without=UNREAD)
            for name, rows in (self._rows(p, n, start) for n in MARTS):
                columns, months = self._write(name, rows, version)
                marts[name]["columns"] = columns
                marts[name]["months"] |= {m: version for m in months}
                if name == HOLDINGS:                               # values are summed from the rows just written
                    p.__dict__["_refreshed"] = self.spark.read.schema(columns).parquet(
                        *[f"{self.root}/{HOLDINGS}/version={version}/{MONTH}={m}" for m in months]) if months else rows
        else:
            for name in MARTS:
                marts[name] = before["marts"][name]
        state = {"version": version, "marks": marks, "as_of": as_of, "horizon": p.horizon, "from": f"{start:%Y-%m}", "marts": marts}
        self.versions.commit(f"{version:08d}.json", state)
        return state

    @staticmethod
    def _start(before: dict | None, changed: _dt.date | None, p: Portfolio) -> _dt.date:
        """First day of the first month to rebuild: that of the earliest change, or of the first day not built yet."""
        first = _dt.date.fromisoformat(p.cal_start)
        if before is None:
            return first
        grown = _dt.date.fromisoformat(before["horizon"]) + _dt.timedelta(days=1)
        # a month's snapshot appears once the month is complete, i.e. in the month behind it
        days = [grown - _dt.timedelta(days=grown.day)] if p.as_of != before["as_of"] else []
        return max(first, min([*days, *([changed] if changed else [])])).replace(day=1)

    @staticmethod
    def _rows(p: Portfolio, name: str, start: _dt.date) -> tuple[str, DataFrame]:
        if name == HOLDINGS:
            return name, p._holdings("day", (f"{start}", p.horizon))
        if name == VALUES:
            return name, p._value_by_day(p.__dict__["_refreshed"])
        return name, p.portfolio_snapshot_monthly.filter(F.col("year_month") >= f"{start:%Y-%m}")

    def _write(self, name: str, rows: DataFrame, version: int) -> tuple[str, list[str]]:
        """Write the months of ``rows`` as a version's folders; (columns, months written)."""
        told, entity = MARTS[name]
        month = F.col(told) if told == "year_month" else F.date_format(told, "yyyy-MM")
        path = f"{self.root}/{name}/version={version}"
        (rows.withColumn(MONTH, month).repartitionByRange(MONTH, entity).sortWithinPartitions(MONTH, entity)
         .write.mode("overwrite").partitionBy(MONTH).parquet(path))
        fs = self.versions.fs
        found = [s.getPath().getName() for s in fs.listStatus(self.versions.path_of(path))]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return columns, sorted(n.split("=", 1)[1] for n in found if n.startswith(f"{MONTH}="))

"""The full model set: star schema, snapshots, returns and serving marts."""

from __future__ import annotations

import inspect
import threading
import uuid
from collections import defaultdict
from collections.abc import Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial

from pyspark.sql import DataFrame

from ledgerline.plans.derived import Derived
from ledgerline.session import checkpoint_dir
from ledgerline.sources.fixture import RawSources
from ledgerline.sources.writers import shuffles_removed, write_scratch

# Models written as tables by ``materialise_core``, in dependency order. Each
# entry: (attribute, columns to sort by inside each output file).
CORE_MODELS = [
    ("dim_account", ["account_name"]),
    ("dim_fund", ["fund_id"]),
    ("dim_transaction_type", []),
    ("fct_transactions_wide", []),       # as large as the input: a sort would hold a whole split of it in memory
    ("fct_fund_prices_daily", ["fund_key", "price_date"]),
    ("fct_benchmarks_monthly", ["index_id", "year_month"]),
    ("fct_cash_position_daily", ["account_key", "trade_date"]),
    ("unit_steps", ["account_key", "fund_key", "trade_date"]),
]


# Dependency levels of CORE_MODELS: each level reads only the landed sources and earlier levels.
CORE_LEVELS = [
    ["dim_account", "dim_fund", "dim_transaction_type", "fct_benchmarks_monthly"],
    ["fct_transactions_wide", "fct_fund_prices_daily"],
    ["fct_cash_position_daily", "unit_steps"],
]


class Portfolio(Derived):
    """All models for one set of raw sources and one as-of date."""

    def _table_root(self) -> str:
        if not hasattr(self, "_run_id"):
            self._run_id = uuid.uuid4().hex[:12]
        return f"{checkpoint_dir(self.spark).rstrip('/')}/tables/{self._run_id}"

    def _write_read(self, df: DataFrame, name: str, sort_by: list[str]) -> DataFrame:
        path = f"{self._table_root()}/{name}"
        write_scratch(df.sortWithinPartitions(*sort_by) if sort_by else df, path)
        return self.spark.read.parquet(path)

    def materialise_core(self, landed: Collection[str] = (), without: Sequence[str] = ()) -> "Portfolio":
        """Land the raw sources and the core star models as parquet tables.

        The reference builds every non-base model as a table; this does the
        same for the models every mart shares, so a mart reads a few compact
        tables instead of re-deriving the star from the raw sources (one
        monthly-returns plan would otherwise repeat the source joins dozens
        of times). It also cuts lineage: a lost executor recomputes from
        these files, not from the sources. Tables go to the session's
        ``spark.checkpoint.dir`` (shared storage on a cluster) under a fresh
        run folder.

        ``landed``: sources that are written tables already and are read as they are. ``without``: columns of the
        transaction fact that nobody reads afterwards and that are not written.
        """
        raw = self.raw
        written = self._parallel({f: (getattr(raw, f), f"raw_{f}", []) for f in SOURCES if f not in landed})
        self.raw = RawSources(*[written.get(f, getattr(raw, f)) for f in SOURCES])
        for attr in ("base_transactions", "base_prices", "base_benchmarks"):
            self.__dict__.pop(attr, None)
        by_name = dict(CORE_MODELS)
        for level in CORE_LEVELS:
            if without and "fct_transactions_wide" in level:
                self.__dict__["fct_transactions_wide"] = self.fct_transactions_wide.drop(*without)
            # models of one level only depend on earlier levels: build them concurrently
            done = self._parallel({a: (getattr(self, a), a, by_name[a]) for a in level})
            for attr, df in done.items():
                self.__dict__[attr] = df
                self.materialised.add(attr)
        return self

    def _parallel(self, jobs: dict) -> dict:
        """Run independent writes as concurrent Spark jobs (each job alone leaves cores idle)."""
        return self._concurrently({k: partial(self._write_read, *args) for k, args in jobs.items()})

    def _concurrently(self, jobs: dict) -> dict:
        sc = self.spark.sparkContext
        group = sc.getLocalProperty("spark.jobGroup.id")      # job groups are per thread: pass it on

        def run(job):
            if group:
                sc.setJobGroup(group, group)
            return job()
        with shuffles_removed(self.spark), ThreadPoolExecutor(max_workers=len(jobs)) as pool:
            futures = {k: pool.submit(run, job) for k, job in jobs.items()}
            return {k: f.result() for k, f in futures.items()}


SOURCES = ("accounts", "funds", "transactions", "prices", "benchmarks", "ingest_log")


class PortfolioOnRead(Portfolio):
    """Lands each raw source and core model when something first reads it, so that a query writes what it reads and no more:
    the tables of all of them take several times the room of the input."""

    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self._locks, self._landing = defaultdict(threading.RLock), threading.Lock()
        self.raw = _SourcesOnRead(self, self.raw)
        self.materialised |= {name for name, _ in CORE_MODELS}

    def _once(self, held: dict, attr: str, build, name: str, sort_by: list[str]) -> DataFrame:
        """Reports are built by several threads: one of them writes a table, the others wait for it."""
        with self._landing:
            lock = self._locks[name]
        with lock:
            if attr not in held:
                held[attr] = self._write_read(build(), name, sort_by)
            return held[attr]

    def materialise_core(self, landed: Collection[str] = (), without: Sequence[str] = ()) -> "PortfolioOnRead":
        """Land everything that hasn't landed yet."""
        if landed or without:
            raise ValueError("sources land when they are read; use Portfolio")
        for owner, names in [(self.raw, SOURCES), *[(self, level) for level in CORE_LEVELS]]:
            self._concurrently({name: partial(getattr, owner, name) for name in names})
        return self


class _SourcesOnRead:
    def __init__(self, portfolio: PortfolioOnRead, raw: RawSources):
        self._portfolio, self._raw = portfolio, raw

    def __getattr__(self, name: str) -> DataFrame:
        """A source that isn't held yet."""
        if name not in SOURCES:
            raise AttributeError(name)
        return self._portfolio._once(self.__dict__, name, lambda: getattr(self._raw, name), f"raw_{name}", [])


def _on_read(name: str, sort_by: list[str]) -> cached_property:
    define = inspect.getattr_static(Portfolio, name).func
    model = cached_property(lambda p: p._once(p.__dict__, name, lambda: define(p), name, sort_by))
    model.__set_name__(PortfolioOnRead, name)
    return model


for _name, _sort_by in CORE_MODELS:
    setattr(PortfolioOnRead, _name, _on_read(_name, _sort_by))

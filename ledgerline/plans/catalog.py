"""Query catalog: one (Spark builder, oracle SQL) pair per operator.

``register`` binds a name to a function ``(Portfolio) -> DataFrame`` and an
optional DuckDB oracle (a SELECT over the CTEs of ``ledgerline.oracle``).
``__spark_entry__`` exposes both dictionaries to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ledgerline.oracle import with_models

_SPARK: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}
_RAW_ORACLE: dict[str, str] = {}
_GRAIN: dict[str, str] = {}
_ORACLE_KW: dict[str, dict] = {}


def register(name: str, oracle: str | None = None, raw_oracle: str | None = None,
             account_by: str = "nation", oracle_models: dict | None = None):
    """Decorator. ``oracle`` is wrapped in the model CTEs (built with ``oracle_models``
    options); ``raw_oracle`` is used as is; ``account_by`` picks the fixture's account grain."""
    def deco(fn):
        _SPARK[name] = fn
        _GRAIN[name] = account_by
        if oracle is not None:
            _ORACLE[name] = oracle
            _ORACLE_KW[name] = dict(oracle_models or {}, account_by=account_by)
        if raw_oracle is not None:
            _RAW_ORACLE[name] = raw_oracle
        return fn
    return deco


@lru_cache(maxsize=8)
def _portfolio(spark: SparkSession, sf_dir: str, account_by: str = "nation"):
    """One model set per (session, data folder, account grain); sources and core models are written once, when first read."""
    from ledgerline.plans.portfolio import PortfolioOnRead
    return PortfolioOnRead.from_testdata(spark, sf_dir, account_by)


def build(spark: SparkSession, sf_dir: str, account_by: str = "nation"):
    """The model set with all of its sources and core models written."""
    return _portfolio(spark, sf_dir, account_by).materialise_core()


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def bind(fn, grain):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(_portfolio(spark, sf_dir, grain))
        run.__name__ = fn.__name__
        return run
    return {k: bind(v, _GRAIN.get(k, "nation")) for k, v in _SPARK.items()}


def oracle_queries() -> dict[str, str]:
    _load_all()
    out = {k: with_models(v, **_ORACLE_KW.get(k, {})) for k, v in _ORACLE.items()}
    out.update(_RAW_ORACLE)
    return out


def _load_all():
    # importing the modules runs their @register decorators
    import ledgerline.plans.queries  # noqa: F401
    import ledgerline.plans.queries_serving  # noqa: F401
    import ledgerline.plans.queries_ingest  # noqa: F401
    import ledgerline.plans.queries_more  # noqa: F401
    import ledgerline.plans.queries_ops  # noqa: F401

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from ledgerline.plans.portfolio import Portfolio  # noqa: E402
from ledgerline.sources.fixture import RawSources  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="ledgerline-test-")
    s = (SparkSession.builder.master("local[*]").appName("ledgerline-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s


def seeded_portfolio(spark, as_of="2024-12-31", raw: RawSources | None = None, **models) -> Portfolio:
    """A Portfolio whose models are given frames (the reference's hand-seeded marts)."""
    p = Portfolio(spark, raw, as_of=as_of, calendar_start="2016-01-01", calendar_end="2025-12-31")
    for name, df in models.items():
        p.__dict__[name] = df
        p.materialised.add(name)
    return p

"""Broadcast joins behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values as text plus a fixed share per row: one aggregate over the rows."""
    row = df.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 16).alias("n")).first()
    return int(row["n"] or 0)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """(``df`` with a broadcast hint, True) if its measured size is within ``limit``, else (``df``, False).

    Without the hint the join is a shuffle join, which adaptive execution splits where a key is hot.
    """
    if measured_bytes(df) <= limit:
        return F.broadcast(df), True
    return df, False

"""Idempotent appends, last-write-wins upserts, audit rows and materialisation.

There is no table format with MERGE here, so every write is set-based:
dedupe the batch inside itself, anti-join it against the target on the key,
append what is left. Re-running the same batch appends nothing.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import checkpoint_dir

AUDIT_SCHEMA = T.StructType([
    T.StructField("run_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("rows_inserted", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("detail", T.StringType()),
])


def dedupe_first(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` columns (ascending, nulls first), a
    deterministic stand-in for file order.

    An aggregation (``min_by`` of the whole row), not a window: copies are collapsed
    map-side before the shuffle, so a group of identical copies holding a large share
    of all rows never lands in one task. The keys stand beside the row, so a reader of
    the keys alone shuffles nothing else.
    """
    rest = [c for c in batch.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(0)
    least = batch.groupBy(*keys).agg(F.min_by(row, ordering).alias("_row"))
    return least.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in batch.columns])


def insert_or_ignore(target: DataFrame | None, batch: DataFrame, keys: Sequence[str],
                     order: Sequence[str] | None = None, prune_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A10: (rows to append, target after the append). Existing keys win.

    ``prune_by`` names a date column that is a function of the key (a transaction's id holds its trade date):
    only target rows between the batch's first and last such date can repeat a key, so only they are read.
    """
    new = dedupe_first(batch, keys, list(order) if order else [])
    if target is not None:
        held = target
        if prune_by:
            lo, hi = batch.agg(F.min(prune_by), F.max(prune_by)).first()
            held = target.filter(F.col(prune_by).between(F.lit(lo), F.lit(hi)))
        new = new.join(held.select(*keys), list(keys), "left_anti")
        return new, target.unionByName(new.select(*target.columns))
    return new, new


def upsert_replace(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last write wins per key (the batch replaces existing rows with the same key)."""
    both = (target.withColumn("_seq", F.lit(0))
            .unionByName(batch.select(*target.columns).withColumn("_seq", F.lit(1))))
    # aggregation rather than a window: many copies of one key combine map-side
    return (both.groupBy(*keys)
            .agg(F.max_by(F.struct(*[F.col(c) for c in target.columns]), F.col("_seq")).alias("_row"))
            .select("_row.*"))


def audit_row(spark: SparkSession, run_at: _dt.datetime, source: str, rows_inserted: int | Column,
              status: str, detail: str | None = None) -> DataFrame:
    """One audit record; ``rows_inserted`` may be a scalar-subquery column."""
    one = spark.range(1)
    return one.select(F.lit(run_at).cast("timestamp").alias("run_at"), F.lit(source).alias("source"),
                      (rows_inserted if isinstance(rows_inserted, Column) else F.lit(rows_inserted))
                      .cast("int").alias("rows_inserted"),
                      F.lit(status).alias("status"), F.lit(detail).cast("string").alias("detail"))


def append_audit(log_path: str, row: DataFrame, run: str | None = None) -> None:
    """Append an audit row; with ``run`` given, a repeated run replaces its own row."""
    if run is None:
        row.write.mode("append").parquet(log_path)
    else:
        row.write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/run={run}")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of the file system itself: other errors are not taken for a missing table."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint dir (shared storage on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


OPEN_WRITERS = 64
SCRATCH_CODEC = "zstd"           # of tables written on the way: hashes as hex digits and descriptions take about half of snappy's bytes


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a block."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def open_writers(spark: SparkSession, n: int = OPEN_WRITERS):
    """Partitioned writes of a task keep up to ``n`` files open instead of sorting the whole task by partition; what
    belongs to further partitions is sorted, as without."""
    return setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(n))


def shuffles_removed(spark: SparkSession):
    """A write's shuffle files go when it ends. Without, they stay on the executors' disks until the driver happens to
    collect its garbage, and several steps' files add up."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def write_scratch(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` as a compact parquet table (replacing the folder), leaving no shuffle files behind."""
    writer = df.write.mode("overwrite").option("compression", SCRATCH_CODEC)
    with shuffles_removed(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_observed(df: DataFrame, path: str, partition_by: Sequence[str] = (), **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` (replacing the folder) and read it back, with aggregates taken while it is written.

    The observation rides on the write, so counting costs no second evaluation of the frame.
    """
    spark, seen = df.sparkSession, Observation()
    write_scratch(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), path, partition_by)
    return spark.read.schema(df.schema).parquet(path), seen.get


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = (), sort_within: Sequence[str] = ()) -> DataFrame:
    """Full-refresh write to the shared checkpoint folder, then read back.

    Cuts lineage (an executor lost later recomputes from these files, not from
    the raw sources) and lets downstream models prune partitions.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex[:12]}/{name}"   # a folder of its own each time
    w = df
    if sort_within:
        w = w.sortWithinPartitions(*sort_within)
    write_scratch(w, path, partition_by)
    return spark.read.parquet(path)

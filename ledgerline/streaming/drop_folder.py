"""Incremental drop-folder ingestion with Structured Streaming (L1).

New broker CSV files landing in a folder tree are picked up by a file-source
stream (``trigger(availableNow=True)`` for a daily run, or a processing-time
trigger for a long-running one). Each micro-batch goes through the same scan,
parse, classification and fund match as the batch job, then an idempotent
append: rows are deduplicated on their content-hash id inside the batch and
anti-joined against the target table before they are written. Late files are
fine: the key is content-based, not time-based, so no watermark is needed.

Batches are atomic. A batch parses its files once into a scratch table, stages
its new rows, rejects, counts per file and audit row in folders of its own
number, and commits by one manifest (``sources/commits.py``), which
``read_target`` and ``read_report`` go by. A batch that died before its commit is replayed in full
and overwrites its own folders; it is compared with batches in front of it
only, so its rows and counts come out the same. One that died after its
commit finds its manifest and only restores its audit row.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources import broker_csv as B
from ledgerline.sources.commits import BatchTable, read_committed
from ledgerline.sources.writers import append_audit, audit_row, dedupe_first, drop_scratch, scratch_path, write_observed, write_scratch

PARTITION_COL = "trade_month"
# Deterministic winner among rows with the same content id: smallest (ascending, nulls first).
TX_ORDER = ["settle_date", "raw_description", "quantity"]


def start_drop_folder_ingest(spark: SparkSession, drop_dir: str, target_dir: str, checkpoint: str,
                             funds: DataFrame, available_now: bool = True, report_dir: str | None = None,
                             accounts: DataFrame | None = None):
    """Start the stream; returns the StreamingQuery (call ``awaitTermination`` for availableNow).

    ``report_dir`` (default: beside the target) gets ``rejects``, ``counts`` and ``audit``.
    """
    report = report_root(target_dir, report_dir)
    stream = (spark.readStream.format("text").option("recursiveFileLookup", "true").load(drop_dir)
              .select("value", F.col("_metadata.file_path").alias("source_file"),
                      F.col("_metadata.file_block_start").alias("block")))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        def log(rows: int, status: str, detail: str | None) -> None:
            append_audit(f"{report}/audit", audit_row(spark, _dt.datetime.now(_dt.timezone.utc), "transactions", rows,
                                                      status, detail), run=f"{epoch_id}")
        table = BatchTable(spark, target_dir)
        done = table.committed().get(epoch_id)
        if done is not None:                                       # died behind its commit: nothing is left to do
            log(done["rows"], "success", None)
            return
        try:
            facts = stage_batch(batch, epoch_id, table, report, funds, accounts)
            log(facts["rows"], "success", None)
            table.commit(epoch_id, **facts)
        except Exception as error:
            log(0, "failure", str(error)[:1000])
            raise

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def report_root(target_dir: str, report_dir: str | None = None) -> str:
    return (report_dir or f"{target_dir.rstrip('/')}-report").rstrip("/")


def stage_batch(batch: DataFrame, epoch_id: int, table: BatchTable, report: str, funds: DataFrame,
                accounts: DataFrame | None) -> dict:
    """Write a batch's new rows, rejects and counts per file into its folders; {rows: inserted, processed: lines}."""
    spark = batch.sparkSession
    lines = batch.select(B.cp1252_text(F.col("value")).alias("line"), "source_file",
                         F.struct("block", F.monotonically_increasing_id().alias("row")).alias("pos"))
    scratch = scratch_path(spark, "parsed-batch")
    matched, seen = write_observed(B.match_parsed(B.parse_broker_rows(B.named_records(lines)), funds, accounts), scratch,
                                   processed=F.count(F.lit(1)))
    rows, rejects = B.ingest_matched(matched)
    new = dedupe_first(rows, ["id"], TX_ORDER).withColumn(PARTITION_COL, F.date_format("trade_date", "yyyy-MM"))
    held = table.read(before=epoch_id)
    if held is not None:
        # The id hashes the trade date, so a duplicate can only sit in the same trade month:
        # read just the target partitions this batch touches (a list bounded by the calendar).
        months = [r[0] for r in matched.select(F.date_format("trade_date", "yyyy-MM")).distinct().collect()]
        new = new.join(held.filter(F.col(PARTITION_COL).isin(months)).select("id"), "id", "left_anti")
    # few files per month, and a month with many rows is split
    written, got = write_observed(new.hint("rebalance", PARTITION_COL), table.folder(epoch_id), partition_by=[PARTITION_COL],
                                  inserted=F.count(F.lit(1)))
    write_scratch(rejects, f"{report}/rejects/batch={epoch_id}")
    rejects = spark.read.schema(rejects.schema).parquet(f"{report}/rejects/batch={epoch_id}")
    counts = B.ingest_counts(rows, written, "source_file", rejects)
    write_scratch(counts, f"{report}/counts/batch={epoch_id}")
    drop_scratch(spark, scratch)                   # everything that was made of it is written
    return {"rows": got["inserted"], "processed": seen["processed"]}


def read_target(spark: SparkSession, target_dir: str) -> DataFrame | None:
    """The committed transactions; None before the first commit."""
    rows = read_committed(spark, target_dir)
    return None if rows is None else rows.drop("source_file")


def read_report(spark: SparkSession, target_dir: str, name: str, report_dir: str | None = None) -> DataFrame:
    """``rejects``, ``counts`` (of committed batches) or ``audit`` (every batch's last attempt), with their batch."""
    report = spark.read.parquet(f"{report_root(target_dir, report_dir)}/{name}")
    if name == "audit":
        return report
    done = sorted(BatchTable(spark, target_dir).committed())
    return report.filter(F.col("batch").isin(done))

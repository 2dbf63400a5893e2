"""Pages of a long log by rank (F1, D16): the log range-partitioned in page order, with a count per part.

The log is written once in (group, date descending, id) order, each range in a folder of its own, beside a small table of
rows per part and group. A page's OFFSET is looked up in the running counts, so page 10,000 reads the one or two
parts that hold it, and the total comes from the same counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"
ROWS_A_PART = 250_000
MOST_ROWS = 200


class RankIndex:
    def __init__(self, spark: SparkSession, root: str, group: str | None = None):
        """``group``: a column whose values have pages of their own (None: one log)."""
        self.spark, self.root, self.group = spark, root.rstrip("/"), group

    @staticmethod
    def _order() -> list:
        return [F.col("trade_date").desc_nulls_last(), F.col("id").asc()]

    def build(self, log: DataFrame, parts: int | None = None) -> "RankIndex":
        parts = parts or max(1, -(-log.count() // ROWS_A_PART))
        order = [F.col(self.group).asc(), *self._order()] if self.group else self._order()
        (log.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order)
         .write.mode("overwrite").partitionBy(PART).parquet(f"{self.root}/log"))
        (self.spark.read.parquet(f"{self.root}/log").groupBy(PART, *([self.group] if self.group else [])).agg(F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{self.root}/counts"))
        return self

    def _counts(self, value) -> list[tuple[int, int]]:
        """(part, rows) of one group in order: a row per part that holds some of it."""
        counts = self.spark.read.parquet(f"{self.root}/counts")
        if self.group:
            counts = counts.filter(F.col(self.group) == F.lit(value))
        return sorted((r[PART], r["n"]) for r in counts.collect())

    def total(self, value=None) -> int:
        return sum(n for _, n in self._counts(value))

    def page(self, page: int = 1, per_page: int = 50, value=None) -> DataFrame:
        """The rows of a page in order, each with the ``total`` of its group."""
        if page < 1 or not 1 <= per_page <= MOST_ROWS:
            raise ValueError(f"page >= 1 and 1 <= per_page <= {MOST_ROWS}")
        counts, first = self._counts(value), (page - 1) * per_page
        at, parts, skipped = 0, [], 0
        for part, n in counts:
            if at < first + per_page and at + n > first:
                parts.append(part)
            elif not parts:
                skipped += n
            at += n
        log = self.spark.read.option("basePath", f"{self.root}/log").parquet(*[f"{self.root}/log/{PART}={p}" for p in parts]) \
            if parts else self.spark.read.parquet(f"{self.root}/log").filter(F.lit(False))
        if self.group:
            log = log.filter(F.col(self.group) == F.lit(value))
        return (log.drop(PART).orderBy(*self._order()).offset(first - skipped if parts else 0).limit(per_page)
                .withColumn("total", F.lit(at).cast("bigint")))

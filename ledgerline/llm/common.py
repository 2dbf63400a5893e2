"""Helpers shared by the training-data operators: inputs, word rules, tables in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_dir

# Words are runs of bytes outside \x00-\x2F \x3A-\x60 \x7B-\x7F after A-Z became a-z. On UTF-8 bytes that
# is one translation (every separator becomes a blank) and a split; bytes above 0x7F always belong to words.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
WORD_BYTES = bytearray(range(256))
for _b in _SEPARATORS:
    WORD_BYTES[_b] = 0x20
for _b in range(0x41, 0x5B):
    WORD_BYTES[_b] = _b + 0x20
WORD_BYTES = bytes(WORD_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def slices(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that only a part's texts are held as Python objects."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row; a null text counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, so that later work survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per Spark application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="ledgerline-src-")) / "ledgerline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package's sources at hand on the executors.

    Python workers outlive their tasks; what a task has freed is given back to the system at its end, so that
    idle workers of one stage do not take the memory of the next.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of the Arrow pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a bitmap of ``bits`` bits (a power of two, 2^15 at least) that holds a column of 64-bit hashes by their low
    bits. Its size is the same however many rows there are; at most bits / 2^15 parts of 4 KB come to the driver."""
    # the bitmap functions count positions from 1, in buckets of 2^15 numbered from 1
    at = hashes.select((F.col(hashes.columns[0]).bitwiseAND(F.lit(bits - 1)) + 1).alias("at"))
    parts = (at.groupBy(F.bitmap_bucket_number("at").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("part")).collect())
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in parts:
        out[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(bytes(r["part"]), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of some unsigned 64-bit hashes a bitmap may hold."""
    at = hashes % np.uint64(len(bits) * 8)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one column ``_row``, so that no column of theirs can clash with a working column."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"))


def unpacked(columns: list[str], **changed) -> list:
    """The columns of a packed row, some of them replaced."""
    return [(changed[c] if c in changed else F.col(f"_row.{quoted(c)}")).alias(c) for c in columns]

"""Tables written batch by batch with a commit per batch (L1).

A batch writes its rows into a folder of its own and then a manifest, which is put in place by one rename. Readers list the
manifests and read the folders of committed batches only, so rows of a batch that died half-way are never seen, and a
replayed batch overwrites its own folder. ``compact`` rewrites all committed batches as one folder, under a manifest of its
own that stands for them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_commits"
ROWS = "rows"


class Manifests:
    """Small JSON files in one folder, each put in place whole by a rename; one that is there is never replaced."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.jvm = folder, spark._jvm
        self.fs = self.path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path_of(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def read_all(self) -> dict[str, dict]:
        folder = self.path_of(self.folder)
        if not self.fs.exists(folder):
            return {}
        found = {}
        for status in self.fs.listStatus(folder):
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                stream = self.fs.open(status.getPath())
                try:
                    found[name] = json.loads(bytes(stream.readAllBytes()))
                finally:
                    stream.close()
        return found

    def commit(self, name: str, manifest: dict) -> None:
        draft, final = self.path_of(f"{self.folder}/_{uuid.uuid4().hex}"), self.path_of(f"{self.folder}/{name}")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            if not self.fs.exists(final):
                raise OSError(f"cannot commit {final}")


class BatchTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, f"{self.root}/{MANIFESTS}")

    def committed(self) -> dict[int, dict]:
        """Manifest by batch."""
        return {m["batch"]: m for m in self.manifests.read_all().values() if "batch" in m}

    def folder(self, batch: int) -> str:
        return f"{self.root}/{ROWS}/batch={batch}"

    def commit(self, batch: int, **facts) -> None:
        """Make a batch's folder part of the table; ``facts`` stand in the manifest."""
        self.manifests.commit(f"batch-{batch}.json", {"batch": batch, **facts})

    def append(self, rows: DataFrame) -> int:
        """Write and commit ``rows`` as the next batch (one writer at a time); its number."""
        batch = max(self.committed(), default=-1) + 1
        rows.write.mode("overwrite").parquet(self.folder(batch))
        self.commit(batch)
        return batch

    def read_batches(self, batches: list[int]) -> DataFrame:
        return (self.spark.read.option("basePath", f"{self.root}/{ROWS}")
                .parquet(*[self.folder(b) for b in batches]).drop("batch"))

    def read(self, before: int | None = None) -> DataFrame | None:
        """Rows of the committed batches (those numbered below ``before``, if given); None if there are none."""
        manifests = self.manifests.read_all().values()
        upto = max((m["upto"] for m in manifests if "upto" in m and (before is None or m["upto"] < before)), default=None)
        batches = sorted(m["batch"] for m in manifests if "batch" in m and m.get("rows", 1)
                         and (upto is None or m["batch"] > upto) and (before is None or m["batch"] < before))
        parts = []
        if upto is not None:
            parts.append(self.spark.read.parquet(f"{self.root}/{ROWS}/upto={upto}"))
        if batches:
            parts.append(self.read_batches(batches))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def compact(self, partition_by: str | None = None) -> int | None:
        """Rewrite the rows of all committed batches as one folder; the last batch in it (None: nothing committed).

        Readers go on with the old folders until the new manifest is in place.
        """
        done = self.committed()
        if not done:
            return None
        upto, rows = max(done), self.read()
        if rows is not None:
            writer = (rows.hint("rebalance", partition_by) if partition_by else rows).write.mode("overwrite")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{ROWS}/upto={upto}")
            self.manifests.commit(f"upto-{upto}.json", {"upto": upto})
        return upto


def read_committed(spark: SparkSession, root: str) -> DataFrame | None:
    """The committed rows of a table written batch by batch."""
    return BatchTable(spark, root).read()

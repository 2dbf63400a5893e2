"""SparkSession construction and shared-storage locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session time (dates from epoch millis and
# oracle comparisons), AQE for runtime re-planning (coalescing small shuffle
# partitions, broadcast conversion from measured sizes, skew-join splitting),
# and no web UI (no listening port beyond the driver's own RPC).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only from measured sizes: no plan-time size-based broadcast (estimates cannot see
    # explodes or filters on skewed data); AQE converts a shuffle join to a broadcast at run time
    # when the materialised side is actually under the threshold. Explicit hints remain for
    # dimensions whose size is bounded by definition (calendar, transaction types).
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int | None = None,
                  app_name: str = "ledgerline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    # on a cluster the setting stays as configured there (AQE coalesces); a local session gets a few
    if shuffle_partitions is None and re.match(r"local(\[|$)", master):
        shuffle_partitions = 8
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset.

    On a cluster the setting names shared storage every executor can reach, so
    checkpoints and materialised tables survive executor loss. Only local runs
    (tests, bench) get a fresh private scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master or ""
        if not re.match(r"local(\[|$)", master):      # local-cluster has executors of its own
            # a driver-local folder is invisible to executors: refuse rather than scatter files
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for cluster runs")
        current = tempfile.mkdtemp(prefix="ledgerline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def checkpoint_dir(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)

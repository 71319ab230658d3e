"""Session construction and shared-storage helpers.

All operators are lazy ``DataFrame -> DataFrame`` functions; this module only
builds a session for tests / bench and resolves where durable intermediate
state (stream checkpoints, folded tables) lives.  On a cluster that location
is the shared folder named by ``spark.checkpoint.dir``; we only invent one
when the session has none (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Session settings every job relies on: UTC wall clock (the reference stores
# timestamptz and buckets in UTC), AQE for runtime coalescing / skew splits.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Python workers and the state of streaming processors talk to the JVM over local files, not ports
    "spark.python.unix.domain.socket.enabled": "true",
}

# Runtime SQL settings the operators rely on; applied to any session handed to us.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # metadata merge: span-level keys win over defaults
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # per-group top-k up to 4096 rows (span text head) runs as a partial WindowGroupLimit
    "spark.sql.optimizer.windowGroupLimitThreshold": "4096",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "spanlake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if "SPANLAKE_DRIVER_MEMORY" in os.environ:
        conf["spark.driver.memory"] = os.environ["SPANLAKE_DRIVER_MEMORY"]
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Bucket boundaries and range filters are defined in UTC; see RUNTIME_CONF.

    Also ships this package to the executors' Python workers (the stateful span
    function and the JSON line source are resolved by module there).
    """
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """``addPyFile`` a zip of the package once per SparkContext (like ``--py-files``)."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="spanlake-pyfiles-"), "spanlake.zip")  # driver-side upload source
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and folded tables.

    Read from the session (``spark.checkpoint.dir`` / SparkContext); only when
    nothing is configured (local tests) a fresh private folder is created.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="spanlake-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/spanlake/{name}-{uuid.uuid4().hex[:12]}"


def scale_settings(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, from the input size and the number of task slots.

    * scan splits and shuffle partitions of about ``target_partition_bytes``
      (AQE coalesces smaller ones at run time, so the count is an upper bound),
      at least 2 waves of tasks over all cores;
    * skew-join splitting for partitions 5x the median and above 1 GiB.
    Apply with ``spark.conf.set`` before building the plans (state partitions
    of a streaming query are fixed at its first start).
    """
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
    }

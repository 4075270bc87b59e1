"""Spark session defaults and the shared checkpoint folder.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; we
read it from the session and only fall back to a fresh scratch folder when it
is unset (local tests).
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files go when their DataFrame is garbage
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(input_bytes: int, executor_cores: int = 4, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a cluster run over ``input_bytes`` of input.

    Shuffle partitions start at input / 256 MB (AQE coalesces small ones and
    splits skewed ones); scans read 256 MB splits; broadcasts stay at the
    64 MB bound that ``maybe_broadcast`` also uses.
    """
    parts = max(200, int(input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.executor.cores": str(executor_cores),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def get_session(master: str | None = None, app: str = "claimlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    Only a session without executors of its own (master local[...], as in tests)
    may have none: a fresh scratch folder is then created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="claimlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    A reliable checkpoint computes its input once for the eager action and
    again for the checkpoint write; persisting first makes the write read the
    cached blocks instead, so the plan runs once. The cache is released as
    soon as the files are written; later reads come from the checkpoint."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist(blocking=False)


def stage_path(spark: SparkSession, name: str) -> str:
    """A path for a written stage table inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "stages", name)


_SHIPPED: set = set()


def _package_zip() -> bytes:
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    return buf.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Make ``claimlens`` importable on every executor's Python workers.

    The package is zipped in memory, written into the shared checkpoint
    folder through the Hadoop file system and added with ``addPyFile``; once
    per application."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    data = _package_zip()
    name = f"claimlens-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    base = checkpoint_dir(spark)
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(base.rstrip("/") + "/pyfiles/" + name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(key)

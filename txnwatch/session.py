"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers are
for tests, the bench and command-line use.  On a cluster the caller's session
(and its ``spark.checkpoint.dir``) is used as it is.
"""

from __future__ import annotations

import ctypes
import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "txnwatch", extra: dict | None = None) -> SparkSession:
    """Local session with the settings the library is tuned for."""
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TXNWATCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="txnwatch-warehouse-"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    ``spark.checkpoint.dir`` names the shared folder on a cluster and is used as
    given.  Only when it is unset *and* the master is local (tests, the bench)
    is a fresh scratch folder created; on a cluster an unset directory is an
    error, because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running txnwatch jobs")
    path = tempfile.mkdtemp(prefix="txnwatch-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint directory for tables a job writes."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid

    return f"{base}/txnwatch-{name}-{uuid.uuid4().hex[:12]}"


def give_back() -> None:
    """Return what finished work left free to the system: an idle Python worker keeps it otherwise, beside the
    tasks of the next stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def clear_work(spark: SparkSession) -> None:
    """Delete this application's scratch folder (checkpoints and ``work_dir`` tables) once its
    results are stored elsewhere.  Spark makes a folder of its own for every application."""
    path = spark.sparkContext.getCheckpointDir()
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``txnwatch`` importable in Python workers (needed by the pandas
    functions) in local mode, where workers start in an arbitrary directory:
    zip the package once per application and ``addPyFile`` it.  On a cluster
    the package is installed on the executors (or passed with ``--py-files``),
    so nothing is written to a machine-local folder there."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or not sc.master.startswith("local"):
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="txnwatch-pkg-")
    archive = shutil.make_archive(os.path.join(out, "txnwatch"), "zip", os.path.dirname(pkg_dir), "txnwatch")
    sc.addPyFile(archive)
    _SHIPPED.add(key)

"""Session and scratch-storage helpers.

The library never builds a session behind the caller's back; these helpers are
for tests, the bench and the examples.  Scratch tables (stage outputs, lineage
cuts, round-trip fixtures) go under the shared folder named by
``spark.checkpoint.dir``; only when a session has none (local tests) do we set
one ourselves.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "dpmine", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch tables.

    Read from the session (``spark.checkpoint.dir``); a private one is set
    only in local mode when the session has none, as in tests.  On a cluster
    a missing setting is an error: a machine-local folder would not be shared.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            return os.path.dirname(current.rstrip("/")) if current.startswith("/") else current
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="dpmine-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder of this application under the shared checkpoint root."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/dpmine-scratch/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables.

    Call it when the DataFrames built from them have been written or are no
    longer needed; nothing is deleted behind the caller's back.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as a parquet table under the shared checkpoint root and reading it back.

    Columnar and compressed (unlike RDD checkpoint files), and the re-read
    plan carries file statistics for AQE.  A lost executor then costs a
    re-read of this table, not a re-run of everything upstream.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def release_memory() -> None:
    """Hand freed memory of Arrow and of the C library (where it can) back to the system: workers live on between stages."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``dpmine`` importable in the Python workers (once per SparkContext).

    Batch functions (``mapInArrow``/``mapInPandas``) are pickled by reference
    to this package; when it is not installed on the workers (e.g. the code is
    run straight from a checkout), the package is zipped on the driver and
    added with ``addPyFile``, which Spark distributes like ``--py-files``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="dpmine-pyfiles-")
    archive = os.path.join(staging, "dpmine.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    try:
        sc.addPyFile(archive)
    except Exception:  # noqa: BLE001 - already registered in this context by another module instance
        pass
    _SHIPPED.add(app)

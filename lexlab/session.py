"""Session and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# Settings every lexlab job wants; applied only if the caller did not set them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_LOCAL_ROOT: dict[str, str] = {}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "lexlab") -> SparkSession:
    """Return the active session, or build a local one for tests / bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("LEXLAB_MASTER", "local[8]"))
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("LEXLAB_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged tables.

    The folder is the cluster's: the context's checkpoint folder, or the
    setting ``spark.checkpoint.dir``.  Without either, a single-machine
    session (``local[...]``, where driver and executors share one disk) gets a
    temporary folder of its own; any other master raises, because a
    machine-local folder there would be written by one executor and missed by
    the others.  The caller's own settings are never changed.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="lexlab-ckpt-")
    return _LOCAL_ROOT[app]


def scratch_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    """A fresh, unique path under ``root`` (default: the shared checkpoint folder)."""
    return f"{(root or checkpoint_root(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """Filesystem path of a ``file:`` URI (local tests only)."""
    if uri.startswith("file:"):
        uri = uri[5:]
        while uri.startswith("//"):
            uri = uri[1:]
    return uri


def stage_table(df, name: str, fmt: str = "parquet", root: str | None = None):
    """Write ``df`` once to a fresh path under ``root`` (default: the shared
    checkpoint folder) and read it back: a lineage cut that survives executor
    loss and computes the input a single time (``Dataset.checkpoint`` would
    run it twice)."""
    spark = df.sparkSession
    path = scratch_path(spark, name, root)
    df.write.format(fmt).save(path)
    return spark.read.format(fmt).schema(df.schema).load(path)


def drop_staged(*tables) -> None:
    """Delete the files of staged tables that nothing reads any more.

    Only paths under the shared checkpoint folder are touched, so a caller's
    own table is never deleted by mistake."""
    for df in tables:
        spark = df.sparkSession
        root = checkpoint_root(spark)
        jvm = spark._jvm
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        base = jvm.org.apache.hadoop.fs.Path(root)
        top = base.getFileSystem(conf).makeQualified(base).toString().rstrip("/") + "/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            fs = p.getFileSystem(conf)
            if fs.makeQualified(p).toString().startswith(top):
                fs.delete(p, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs that no DataFrame
    refers to any more.  It does so by itself once the driver's JVM collects
    garbage, which a large heap may put off for several jobs.  Asked for twice:
    what Python has let go of may reach the JVM after the first time only."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)

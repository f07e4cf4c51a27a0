"""Session helpers: local session for tests/bench and reliable lineage cuts.

Library functions never create a session; they take DataFrames.  The only
session-level state we touch is the checkpoint directory: it is read from
``spark.checkpoint.dir`` and only filled in for local (test/bench) masters.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "obol") -> SparkSession:
    """Single-JVM session used by tests and bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory the cluster names in ``spark.checkpoint.dir``.

    A directory of our own is set only when the setting is absent and the
    master is local (tests, bench).  On a cluster without the setting we
    refuse rather than write to a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    master = sc.master or ""
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS) "
            "so lineage cuts survive executor loss"
        )
    path = tempfile.mkdtemp(prefix="obol-ckpt-", dir=os.environ.get("OBOL_LOCAL_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable, eager lineage cut (``checkpoint``) in the shared checkpoint dir.

    Used where a later step must see exactly the same rows twice (e.g. range
    buckets), and before iterative ML loops.  Never ``localCheckpoint``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A lineage cut as Parquet in the shared checkpoint dir: for frames read more than once, a few columns at a time."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/obol-stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a Spark application.

    Only the operators that run Arrow batches in Python need it.  The archive
    is built in a folder of the driver; Spark sends it on.
    """
    sc = spark.sparkContext
    with _SHIPPING:  # runs of a search come here at once
        if getattr(sc, "_obol_package", False):
            return
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="obol-package-"), "obol_core.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
        sc._obol_package = True

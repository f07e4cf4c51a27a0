"""Shared-folder staging and input access for the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obol.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_obol_shipped", False):
        return
    import obol
    top = os.path.dirname(os.path.abspath(obol.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="obol-ship-"), "obol_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._obol_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage so that a later read neither recomputes it nor sees other
    rows, and survives the loss of any executor.  ``compression`` names a codec
    other than the session's.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``staged`` that nothing reads any more: all that was made of them is written."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if "/stage/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows of a table of single ids that is sent to every executor.
BROADCAST_IDS = 1 << 21


def sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A table of ids, marked for broadcast if it is counted to be small; a shuffle join is left to Spark beyond that."""
    return F.broadcast(ids) if ids.count() <= most else ids

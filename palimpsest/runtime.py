"""Session helpers shared by every part of the library: shared folder, batch bounds, worker imports."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))
REPO_DIR = os.path.dirname(PACKAGE_DIR)

#: Rows and bytes of one Arrow batch sent to Python at most (one row at least); keeps a batch of long texts small.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a private folder is used in local mode only (tests);
    on a cluster its absence is an error, as a machine-local folder would lose files.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest-{label}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one job in the shared folder: ``drop`` deletes them once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, label: str) -> str:
        self.paths.append(scratch_path(self.spark, label))
        return self.paths[-1]

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        self.paths = []


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make the package importable by Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    sc._palimpsest_shipped = True
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_DIR in on_path:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="palimpsest-code-"), "palimpsest.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(PACKAGE_DIR):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, REPO_DIR))
    sc.addPyFile(archive)
    if REPO_DIR not in sys.path:
        sys.path.insert(0, REPO_DIR)

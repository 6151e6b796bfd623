"""Small state tables in Parquet: run hashes, labels, live maps. Each save is a new snapshot published by a rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest snapshot, or nothing where there is none yet."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def save(df: DataFrame, path: str) -> None:
    """Write a snapshot beside the others, publish it, then drop all but the last two."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))
    version = int(names[-1][1:]) + 1 if names else 0
    temporary = f"{path}/_{uuid.uuid4().hex}"
    df.write.parquet(temporary)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(path_of(temporary), path_of(f"{path}/v{version:012d}")):
        raise OSError(f"cannot publish {path}")
    for old in names[:-1]:
        fs.delete(path_of(f"{path}/{old}"), True)


def get_label(spark: SparkSession, path: str, key: str) -> str:
    """A label's value; empty where it was never set."""
    rows = load(spark, path)
    found = None if rows is None else rows.where(rows.key == key).first()
    return found["value"] if found else ""


def set_label(spark: SparkSession, path: str, key: str, value: str) -> None:
    rows = load(spark, path)
    new = spark.createDataFrame([(key, value)], "key string, value string")
    save(new if rows is None else rows.where(rows.key != key).unionByName(new), path)

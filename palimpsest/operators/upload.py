"""Uploads of segments by many tasks, with a manifest in the store.

A task copies its files, each to a name of its own first, checks sizes, and moves it to its key, so a file in the store is whole.
What was copied, with its CRC-32, is added to the manifest when all tasks are done; a copy that failed is reported, left out of the
manifest, and tried again by the next call, alone. Only names pass the driver.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions.labels import log_key_of
from palimpsest.runtime import prepare, stored
from palimpsest.sources import state
from palimpsest.sources.files import list_segment_files, system_of

#: Bytes that a task holds of a file.
PIECE = 4 << 20
MANIFEST = "label string, key string, bytes long, crc32 long"
RESULT = f"{MANIFEST}, error string"


def manifest_path(store: str, prefix: str, volume: str) -> str:
    return f"{store.rstrip('/')}/{log_key_of(prefix, volume, '').rsplit('/', 1)[0]}/.manifest"


def manifest(spark: SparkSession, store: str, prefix: str, volume: str) -> DataFrame:
    """``label, key, bytes, crc32`` of what was uploaded."""
    rows = state.load(spark, manifest_path(store, prefix, volume))
    return spark.createDataFrame([], MANIFEST) if rows is None else rows


def _copied(pending: DataFrame, folder: str, store: str) -> DataFrame:
    def copy(source_system, path: str, target_system, key: str) -> tuple[int, int]:
        part = f"{key}.part-{TaskContext.get().taskAttemptId()}"
        target_system.create_dir(key.rsplit("/", 1)[0], recursive=True)
        n = crc = 0
        try:
            with source_system.open_input_stream(path) as a, target_system.open_output_stream(part) as b:
                while data := a.read(PIECE):
                    b.write(data)
                    n, crc = n + len(data), zlib.crc32(data, crc)
            if target_system.get_file_info(part).size != n:
                raise OSError(f"{part} is not whole")
            target_system.move(part, key)
        except Exception:
            if target_system.get_file_info(part).type != pa_fs.FileType.NotFound:
                target_system.delete_file(part)
            raise
        return n, crc

    def run(batches):
        (source, _), (target, root) = system_of(folder), system_of(store)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row = {"label": r["label"], "key": r["key"], "bytes": None, "crc32": None, "error": None}
                try:
                    row["bytes"], row["crc32"] = copy(source, r["path"], target, f"{root.rstrip('/')}/{r['key']}")
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("label", pa.string()), ("key", pa.string()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("error", pa.string())]))

    return pending.mapInArrow(run, RESULT)


def upload(spark: SparkSession, folder: str, store: str, prefix: str, volume: str, labels: list[str] | None = None) -> DataFrame:
    """Copy a folder's segments (all, or those of ``labels``) that the manifest lacks; ``label, key, bytes, crc32, error`` of each that was tried.

    A segment that grew or shrank since (a collection writes new labels, so that is rare) is copied anew.
    """
    prepare(spark)
    files = [(label, path, size, log_key_of(prefix, volume, label)) for label, path, size in list_segment_files(folder) if labels is None or label in set(labels)]
    known = manifest(spark, store, prefix, volume)
    pending = spark.createDataFrame(files, "label string, path string, size long, key string").join(known.select("label", F.col("bytes").alias("size")), ["label", "size"], "left_anti")
    if not files:
        return spark.createDataFrame([], RESULT)
    done = stored(_copied(pending.repartition(min(len(files), 4 * spark.sparkContext.defaultParallelism)), folder, store), "uploaded")
    good = done.where("error is null").drop("error")
    if good.limit(1).count():
        state.save(known.join(good.select("label"), "label", "left_anti").unionByName(good).coalesce(1), manifest_path(store, prefix, volume))
    return done

"""Block-log segments: codec, batch source ``blocklog`` and writers.

A segment file ``disk.<label>.log`` is a header map and entry maps with integer keys, back to back.
The source lists segments through Spark (any file system it knows) and decodes one file a row, so
executors need no local access. ``.log.tmp`` files are read only where asked for (crash recovery).
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palimpsest.functions.checks import lz4_pack, lz4_unpack
from palimpsest.functions.labels import label_from_path
from palimpsest.runtime import prepare
from palimpsest.sources.cbor import Truncated, dumps, loads

#: Map keys of the format.
HEADER_KEYS = {1: "version", 2: "block_size", 3: "segment_label", 4: "device_size", 5: "backing_path"}
ENTRY_KEYS = {1: "op", 2: "timestamp_ns", 3: "sequence", 4: "block", 5: "length", 6: "checksum", 7: "data"}
VERSION = 2

_L, _S = T.LongType(), T.StringType()
HEADER_SCHEMA = T.StructType([T.StructField("segment", _S), T.StructField("version", _L), T.StructField("block_size", _L), T.StructField("segment_label", _S), T.StructField("device_size", _L), T.StructField("backing_path", _S)])
ENTRY_SCHEMA = T.StructType([T.StructField("segment", _S), T.StructField("entry_index", _L), *(T.StructField(c, _S if c == "op" else T.BinaryType() if c == "data" else _L) for c in ENTRY_KEYS.values()), T.StructField("compressed_size", _L), T.StructField("block_size", _L)])


def encode_header(label: str, block_size: int, device_size: int, backing_path: str = "", version: int = VERSION) -> bytes:
    return dumps({1: version, 2: block_size, 3: label, 4: device_size, 5: backing_path})


def encode_entry(op: str, timestamp_ns: int, sequence: int, block: int, length: int, data: bytes | None = None, checksum: int | None = None) -> bytes:
    """A write's data is compressed and its checksum computed unless given; a trim has neither."""
    out = {1: op, 2: timestamp_ns, 3: sequence, 4: block, 5: length}
    if op == "W" and data:
        out[6] = zlib.crc32(data) if checksum is None else checksum
        out[7] = lz4_pack(data)
    return dumps(out)


def decode(content: bytes, payload: bool = True, strict: bool = True) -> tuple[dict, list[dict]]:
    """Header and entries of a segment; unknown keys are ignored. A truncated tail is an error, or ends the entries unless ``strict``."""
    raw, at = loads(content)
    header, entries = {name: raw.get(k) for k, name in HEADER_KEYS.items()}, []
    while at < len(content):
        try:
            raw, at = loads(content, at)
            entry = {name: raw.get(k) for k, name in ENTRY_KEYS.items()}
            data = entry["data"]
            entry["compressed_size"] = len(data) if data and entry["op"] == "W" else None
            if not payload:
                entry["data"] = None
            elif data and entry["op"] == "W" and entry["length"]:
                entry["data"] = lz4_unpack(data, entry["length"])
        except (Truncated, ValueError, OSError):
            if strict:
                raise
            break
        entries.append(entry)
    return header, entries


def _files(spark: SparkSession, path: str, include_tmp: bool, after: str | None) -> DataFrame:
    """``segment`` and ``content`` of the segment files; with ``after``, files at or before that label are not opened at all."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.log{,.tmp}" if include_tmp else "*.log")
    label = label_from_path(F.regexp_replace("path", r"\.tmp$", "")).alias("segment")
    if after is None:
        return reader.load(path).select(label, "content")
    newer = [p for name, p, _ in segment_files(spark, path, include_tmp) if name > after]
    if not newer:
        return spark.createDataFrame([], "segment string, content binary")
    return reader.load(newer).select(label, "content")


def _empty(spark: SparkSession, path: str, include_tmp: bool, after: str | None) -> list[str]:
    """Labels of segments without a byte, which Spark's reader passes over."""
    return [name for name, _, size in segment_files(spark, path, include_tmp) if not size and (after is None or name > after)]


def read_headers(spark: SparkSession, path: str, include_tmp: bool = False, after: str | None = None) -> DataFrame:
    """One row a segment: its header."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            rows = [{"segment": s.as_py(), **{HEADER_KEYS[k]: v for k, v in loads(c.as_py())[0].items() if k in HEADER_KEYS}} for s, c in zip(*batch.columns)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, pa.string() if f.dataType == _S else pa.int64()) for f in HEADER_SCHEMA]))

    return _files(spark, path, include_tmp, after).mapInArrow(run, HEADER_SCHEMA)


def read_log(spark: SparkSession, path: str, payload: bool = True, include_tmp: bool = False, after: str | None = None, strict: bool = True) -> DataFrame:
    """Entries of the segments in a folder, in ``entry_index`` order within a segment.

    ``payload=False`` skips decompression for analyses of geometry alone; ``after`` prunes segments
    at or before a label; ``strict=False`` keeps what precedes a truncated tail. An empty file is an
    error when strict.
    """
    prepare(spark)
    if strict and (none := _empty(spark, path, include_tmp, after)):
        raise ValueError(f"empty segments: {', '.join(none[:5])}")
    kinds = {_S: pa.string(), _L: pa.int64()}
    schema = pa.schema([(f.name, kinds.get(f.dataType, pa.binary())) for f in ENTRY_SCHEMA])

    def run(batches):
        for batch in batches:
            for segment, content in zip(*batch.columns):
                try:
                    header, entries = decode(content.as_py(), payload, strict)
                except ValueError:
                    if strict:
                        raise
                    continue
                for a in range(0, len(entries), 256):
                    rows = [{"segment": segment.as_py(), "entry_index": a + i, "block_size": header["block_size"], **e} for i, e in enumerate(entries[a : a + 256])]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _files(spark, path, include_tmp, after).mapInArrow(run, ENTRY_SCHEMA)


def read_partly(spark: SparkSession, path: str, include_tmp: bool = False) -> DataFrame:
    """One row a segment: ``entries`` that can be read, and the ``error`` that ends them (null: none)."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            for segment, content in zip(*batch.columns):
                n, error = 0, None
                try:
                    n = len(decode(content.as_py(), payload=True, strict=False)[1])
                    decode(content.as_py(), payload=True, strict=True)
                except (ValueError, OSError) as e:
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([segment.as_py()]), pa.array([n], pa.int64()), pa.array([error], pa.string())], names=["segment", "entries", "error"])

    found = _files(spark, path, include_tmp, None).mapInArrow(run, "segment string, entries long, error string")
    none = _empty(spark, path, include_tmp, None)
    return found.unionByName(spark.createDataFrame([(x, 0, "no header") for x in none], found.schema)) if none else found


def versioned(entries: DataFrame) -> DataFrame:
    """Entries with ``version`` (segment, position) and ``blocks`` for the overlay operators."""
    blocks = F.greatest(F.floor(F.col("length") / F.col("block_size")).cast("long"), F.lit(1))
    return entries.withColumn("version", F.struct("segment", "entry_index")).withColumn("blocks", blocks)


def unaligned(entries: DataFrame) -> DataFrame:
    """Entries whose length is no multiple of the block size: compaction would cut their tails."""
    return entries.where(F.col("length") % F.col("block_size") != 0)


def _paths(spark: SparkSession, folder: str, label: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, temporary = path(folder, f"disk.{label}.log"), path(folder, f"disk.{label}.log.tmp")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, temporary


def delete_segments(spark: SparkSession, folder: str, labels: list[str]) -> None:
    for label in labels:
        fs, target, _ = _paths(spark, folder, label)
        fs.delete(target, False)


def segment_files(spark: SparkSession, folder: str, include_tmp: bool = False) -> list[tuple[str, str, int]]:
    """Label, path and bytes of each segment file, in label order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in fs.listStatus(path)] if fs.exists(path) else []
    kept = [f for f in found if f[0].endswith(".log") or include_tmp and f[0].endswith(".log.tmp")]
    return sorted((n.removesuffix(".tmp").removesuffix(".log").removeprefix("disk."), p, size) for n, p, size in kept)


def list_segments(spark: SparkSession, folder: str, include_tmp: bool = False) -> list[str]:
    """Segment labels in name order."""
    return [label for label, _, _ in segment_files(spark, folder, include_tmp)]

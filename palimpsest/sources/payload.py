"""Payloads read late: by their places in the segments, after it is known which of them are alive.

Analyses run on geometry alone. What they leave is a table of live ranges, each with its entry's ``data_offset``,
``compressed_size`` and ``ref_length``. A task opens a segment once, seeks to the entries that are asked for, unpacks each
once for all of its ranges, and cuts them out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palimpsest.functions.checks import lz4_unpack
from palimpsest.operators.overlay import newest_runs
from palimpsest.runtime import prepare
from palimpsest.sources import logformat
from palimpsest.sources.files import list_segment_files, segment_name, system_of

#: Columns of the index: an entry's geometry and the place of its payload.
INDEX = ["segment", "entry_index", "op", "timestamp_ns", "sequence", "block", "length", "checksum", "compressed_size", "block_size", "data_offset"]
#: Bytes of payload in a batch that leaves a task (one range at least).
BATCH_BYTES = 8 << 20
#: Segments that a reader is told by name at most; beyond it all indexes are read.
MAX_NAMED = 1000
#: Segments that a task holds open.
OPEN_FILES = 16


def index(spark: SparkSession, folder: str, after: str | None = None, include_tmp: bool = False, mode: str = "FAILFAST", segments: list[str] | None = None) -> DataFrame:
    """The entries of a folder's segments (newer than ``after``, among ``segments``) without a payload, with ``version`` and ``blocks``: no payload byte is read, and no other file opened."""
    rows = logformat.read(spark, folder, INDEX, "DROPMALFORMED" if mode == "PERMISSIVE" else mode, include_tmp, after, segments)
    blocks = F.greatest(F.floor(F.col("length") / F.col("block_size")).cast("long"), F.lit(1))
    return rows.withColumn("version", F.struct("segment", "entry_index")).withColumn("blocks", blocks)


def live_ranges(entries: DataFrame, keys: list[str] = []) -> DataFrame:
    """``start, blocks`` of what is alive of the entries of ``index`` (per key, where given), with their entry's columns: its block as ``ref_block``, its length as ``ref_length``."""
    known = entries.where(F.col("op").isin("W", "T"))
    names = {"block": "ref_block", "blocks": "ref_blocks", "length": "ref_length"}
    owner = known.select("version", *[F.col(c).alias(names.get(c, c)) for c in known.columns if c != "version"])
    return newest_runs(known, keys).drop(*keys).join(owner, "version")


def located(extents: DataFrame, folder: str) -> DataFrame:
    """Extents of a stored live map (``version, segment, op, start, blocks``) as ``live_ranges`` gives them, from the index of their own segments alone.

    Extents of segments that are gone are left out.
    """
    spark = extents.sparkSession
    segments = [r["segment"] for r in extents.select("segment").distinct().limit(MAX_NAMED + 1).collect()]
    rows = index(spark, folder, segments=segments if len(segments) <= MAX_NAMED else None)
    names = {"block": "ref_block", "blocks": "ref_blocks", "length": "ref_length"}
    owner = rows.select(*[F.col(c).alias(names.get(c, c)) for c in rows.columns if c not in ("segment", "op")])
    return extents.select("version", "segment", "op", "start", "blocks", *[c for c in extents.columns if c not in ("version", "segment", "op", "start", "blocks", *owner.columns)]).join(owner, "version")


def fetch(ranges: DataFrame, folder: str) -> DataFrame:
    """``ranges`` of ``live_ranges`` with ``length``, ``data`` (null for trims, and for writes that hold none), and ``fetched``, the stored bytes read for the row.

    Ranges of one entry that follow one another read it once, so sort by ``segment, entry_index, start`` within tasks first.
    """
    prepare(ranges.sparkSession)
    names = [c for c in ranges.columns if c not in ("data", "length", "fetched")]
    made = [T.StructField("length", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("fetched", T.LongType())]
    schema = T.StructType([*(ranges.schema[c] for c in names), *made])
    at = {c: names.index(c) for c in ("segment", "op", "start", "blocks", "block_size", "ref_block", "ref_length", "data_offset", "compressed_size")}

    def run(batches):
        system, root = system_of(folder)
        paths: dict[str, str] | None = None
        files: dict = {}
        entry, unpacked = None, b""

        def opened(segment: str):
            nonlocal paths
            if segment in files:
                files[segment] = files.pop(segment)  # the last used
                return files[segment]
            if len(files) >= OPEN_FILES:
                files.pop(next(iter(files))).close()
            path = f"{root.rstrip('/')}/{segment_name(segment)}"
            try:
                files[segment] = system.open_input_file(path)
            except FileNotFoundError:  # a crashed writer's file
                paths = paths or {label: p for label, p, _ in list_segment_files(folder, True)}
                files[segment] = system.open_input_file(paths[segment])
            return files[segment]

        try:
            for batch in batches:
                wanted = {c: batch.column(i).to_pylist() for c, i in at.items()}
                lengths = [n * size for n, size in zip(wanted["blocks"], wanted["block_size"])]
                out: list = []
                read: list[int] = []
                first, held = 0, 0
                for i, length in enumerate(lengths):
                    data, cost = None, 0
                    if wanted["op"][i] == "W" and wanted["data_offset"][i] is not None and wanted["compressed_size"][i]:
                        segment, offset = wanted["segment"][i], wanted["data_offset"][i]
                        if (segment, offset) != entry:
                            file = opened(segment)
                            file.seek(offset)
                            stored = file.read(wanted["compressed_size"][i])
                            unpacked, entry, cost = lz4_unpack(stored, wanted["ref_length"][i]), (segment, offset), len(stored)
                        skip = (wanted["start"][i] - wanted["ref_block"][i]) * wanted["block_size"][i]
                        data = unpacked[skip : skip + length]
                    out.append(data)
                    read.append(cost)
                    held += len(data or b"")
                    if held >= BATCH_BYTES or i == len(lengths) - 1:
                        part = [c.slice(first, i + 1 - first) for c in batch.columns]
                        yield pa.RecordBatch.from_arrays([*part, pa.array(lengths[first : i + 1], pa.int64()), pa.array(out, pa.binary()), pa.array(read, pa.int64())], names=schema.fieldNames())
                        out, read, first, held = [], [], i + 1, 0
        finally:
            for file in files.values():
                file.close()

    return ranges.select(*names).mapInArrow(run, schema)


def live_pieces(entries: DataFrame, folder: str) -> DataFrame:
    """``offset, length, data, fetched`` of the latest state (null data: zeros): the overlay of the index, then the live ranges' payloads."""
    near = live_ranges(entries).repartition("segment").sortWithinPartitions("segment", "entry_index", "start")
    return fetch(near, folder).select((F.col("start") * F.col("block_size")).alias("offset"), "length", "data", "fetched")

"""The format ``blocklog``: segments as a Spark data source, to read and to write.

    register(spark)
    spark.read.format("blocklog").load(folder).where("segment > '4000...'")
    rows.write.format("blocklog").option("block_size", 4096).mode("append").save(folder)

A segment is a partition; with ``option("partition_bytes", n)`` neighbours that hold ``n`` bytes together at most share one. The options ``after`` (a label) and ``segments`` (a JSON list of labels) choose the files before any
is opened. A schema without ``data`` (``.schema(...)``, or ``option("payload", "false")``) reads no payload at all. With
``option("push_filters", "true")``, conditions on ``segment`` choose files too, and conditions on ``op`` leave payloads unread.
That is an option of a load, not the rule: Spark 4.1 keeps what was pushed last with the loaded DataFrame and reads by it
again, so a DataFrame loaded in this way is for one set of conditions.
Segments are read by the pull parser, a part at a time. What cannot be read ends a segment, in one pass with its entries:
``mode`` FAILFAST (default) raises, PERMISSIVE adds a last row whose ``error`` says why, DROPMALFORMED says nothing.

Writing takes rows of ``segment, op, timestamp_ns, sequence, block, length, data, checksum`` (more columns do no harm) whose
segments are each in one task and in order (see ``write_log``). Files appear when all tasks are done, by renames in label
order; an aborted job leaves none.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from palimpsest.functions.checks import lz4_pack
from palimpsest.runtime import prepare
from palimpsest.sources.cbor import Truncated, dumps
from palimpsest.sources.files import list_segment_files, segment_name, system_of
from palimpsest.sources.pull import Damaged, Pull, read_entries, read_header

NAME, VERSION = "blocklog", 2
_L, _S = T.LongType(), T.StringType()
SCHEMA = T.StructType([
    T.StructField("segment", _S), T.StructField("entry_index", _L), T.StructField("op", _S), T.StructField("timestamp_ns", _L), T.StructField("sequence", _L), T.StructField("block", _L), T.StructField("length", _L),
    T.StructField("checksum", _L), T.StructField("data", T.BinaryType()), T.StructField("compressed_size", _L), T.StructField("block_size", _L), T.StructField("entry_offset", _L), T.StructField("data_offset", _L), T.StructField("error", _S),
])
#: Rows and bytes of payload of a batch at most (one row at least).
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Bytes of small segments that ``read`` gives to one task.
PARTITION_BYTES = 32 << 20
MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")


@dataclass
class Segments(InputPartition):
    files: list[tuple[str, str, int]]  # label, path, bytes


class LogReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        unknown = [f.name for f in schema if f.name not in SCHEMA.fieldNames()]
        if unknown:
            raise ValueError(f"no such columns in a log: {', '.join(unknown)}")
        self.folder, self.schema = options.get("path"), schema
        if not self.folder:
            raise ValueError("give the folder: load(path)")
        self.include_tmp = options.get("include_tmp", "false").lower() == "true"
        self.payload = options.get("payload", "true").lower() == "true" and "data" in schema.fieldNames()
        self.mode = options.get("mode", "FAILFAST").upper()
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.tests, self.ops, self.partition_bytes = [], None, int(options.get("partition_bytes", 0))
        if "after" in options:
            self.tests.append(("__gt__", options["after"]))
        if "segments" in options:
            self.tests.append(("__in__", json.loads(options["segments"])))

    def partitions(self):
        chosen = lambda label: all(label in v if how == "__in__" else getattr(label, how)(v) for how, v in self.tests)
        out: list[Segments] = []
        held = 0
        for f in list_segment_files(self.folder, self.include_tmp):
            if not chosen(f[0]):
                continue
            if not out or held + f[2] > self.partition_bytes:
                out.append(Segments([]))
                held = 0
            out[-1].files.append(f)
            held += f[2]
        return out or [Segments([])]  # a folder without segments still needs a partition

    def read(self, partition):
        for label, path, size in partition.files:
            yield from self._entries(label, path, size)

    def _entries(self, label: str, path: str, size: int):
        arrow = pa.schema([(f.name, pa.string() if f.dataType == _S else pa.int64() if f.dataType == _L else pa.binary()) for f in self.schema])
        rows, held, error = [], 0, None
        with system_of(self.folder)[0].open_input_file(path) as file:
            pull, i = Pull(file, size), 0
            try:
                header = read_header(pull)
                for entry in read_entries(pull, self.payload, self.ops):
                    if self.ops is None or entry["op"] in self.ops:
                        rows.append(entry | {"segment": label, "entry_index": i, "block_size": header["block_size"]})
                        held += len(entry["data"] or b"")
                    i += 1
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
            except (Truncated, Damaged, ValueError, OSError) as e:
                if self.mode == "FAILFAST":
                    raise ValueError(f"segment {label}: {e}") from e
                error = str(e) or type(e).__name__
        if error and self.mode == "PERMISSIVE" and self.ops is None and "error" in arrow.names:
            rows.append({"segment": label, "entry_index": i, "entry_offset": pull.place, "error": error})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class PushingReader(LogReader):
    def pushFilters(self, filters):
        """Conditions on the label choose files, those on the operation choose payloads; others stay with Spark."""
        compare = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__", StringStartsWith: "startswith"}
        for f in filters:
            column, kind = ".".join(f.attribute) if hasattr(f, "attribute") else None, type(f)
            if column == "segment" and kind in compare:
                self.tests.append((compare[kind], f.value))
            elif column == "segment" and kind is In:
                self.tests.append(("__in__", [v for v in f.value if v is not None]))
            elif column == "op" and kind in (EqualTo, In):
                wanted = {f.value} if kind is EqualTo else set(f.value)
                self.ops = wanted if self.ops is None else self.ops & wanted
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # label, path


class LogWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("give the folder: save(path)")
        self.block_size, self.device_size, self.backing = int(options.get("block_size", 4096)), int(options.get("device_size", 0)), options.get("backing_path", "")
        self.overwrite, self.job = overwrite, f"_{NAME}-{uuid.uuid4().hex}"

    def _root(self):
        system, root = system_of(self.folder)
        return system, root.rstrip("/"), f"{root.rstrip('/')}/{self.job}"

    def write(self, iterator):
        system, _, job = self._root()
        context = TaskContext.get()
        own = f"{job}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(own, recursive=True)
        files, out, label, last = [], None, None, None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if r["segment"] != label:
                        if out is not None:
                            out.close()
                        label, last = r["segment"], None
                        if not label or any(label == x for x, _ in files):
                            raise ValueError(f"rows of a segment must come together and have a label: {label!r}")
                        files.append((label, f"{own}/{segment_name(label)}"))
                        out = system.open_output_stream(files[-1][1])
                        out.write(dumps({1: VERSION, 2: self.block_size, 3: label, 4: self.device_size, 5: self.backing}))
                    if last is not None and r["sequence"] <= last:
                        raise ValueError(f"rows of segment {label} are out of order at sequence {r['sequence']}")
                    last = r["sequence"]
                    out.write(encode(r))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        system, root, job = self._root()
        files = sorted(f for m in messages if m is not None for f in m.files)
        labels = [label for label, _ in files]
        there = {label for label, _, _ in list_segment_files(self.folder)}
        twice = {a for a, b in zip(labels, labels[1:]) if a == b} | (set() if self.overwrite else there & set(labels))
        if twice:
            self.abort(messages)
            raise ValueError(f"segments written twice: {', '.join(sorted(twice)[:5])}")
        for label, path in files:
            system.move(path, f"{root}/{segment_name(label)}")
        if self.overwrite:
            for label in there - set(labels):
                system.delete_file(f"{root}/{segment_name(label)}")
        self._clear(system, job)

    def abort(self, messages):
        system, _, job = self._root()
        self._clear(system, job)

    def _clear(self, system, job: str) -> None:
        try:
            system.delete_dir(job)
        except FileNotFoundError:
            pass  # no task wrote


class BlockLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        kind = PushingReader if self.options.get("push_filters", "false").lower() == "true" else LogReader
        return kind(self.options, schema)

    def writer(self, schema, overwrite):
        return LogWriter(self.options, overwrite)


def encode(r: dict) -> bytes:
    """An entry's bytes: a write's data is packed, and its checksum computed unless given; a trim has neither."""
    out = {1: r["op"], 2: r["timestamp_ns"] or 0, 3: r["sequence"], 4: r["block"], 5: r["length"]}
    data, checksum = r.get("data"), r.get("checksum")
    if r["op"] == "W" and data:
        out[6] = zlib.crc32(data) if checksum is None else checksum
        out[7] = lz4_pack(data)
    return dumps(out)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # for loads that ask for it
    spark.dataSource.register(BlockLog)


def read(spark: SparkSession, folder: str, columns: list[str] | None = None, mode: str = "FAILFAST", include_tmp: bool = False, after: str | None = None, segments: list[str] | None = None) -> DataFrame:
    """The entries of a folder's segments (newer than ``after``, among ``segments``); payloads are read where ``columns`` (default: all) hold ``data``."""
    register(spark)
    reader = spark.read.format(NAME).schema(SCHEMA if columns is None else T.StructType([SCHEMA[c] for c in columns])).option("mode", mode).option("include_tmp", str(include_tmp)).option("partition_bytes", PARTITION_BYTES)
    if after is not None:
        reader = reader.option("after", after)
    if segments is not None:
        reader = reader.option("segments", json.dumps(segments))
    return reader.load(folder)


def write_log(rows: DataFrame, folder: str, block_size: int, device_size: int = 0, backing_path: str = "", mode: str = "append") -> None:
    """Write rows of ``segment, op, timestamp_ns, sequence, block, length, data, checksum`` as segments, each in order of ``sequence``, many side by side."""
    register(rows.sparkSession)
    system, root = system_of(folder)
    system.create_dir(root, recursive=True)
    dealt = rows.repartition(F.col("segment")).sortWithinPartitions("segment", "sequence")
    dealt.write.format(NAME).option("block_size", block_size).option("device_size", device_size).option("backing_path", backing_path).mode(mode).save(folder)

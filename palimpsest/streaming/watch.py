"""The watch for rotated segments as a Spark source: events in log order, whose offsets are labels.

    register(spark)
    spark.readStream.format("blocklog_rotations").option("devices", '{"0": "/logs/a", "1": "/logs/b"}').load()

A row is a closed segment of a device's folder: ``type, dev_index, label, dir, path, bytes``. Events come by label (then device), at
most ``segments_per_batch`` in a batch, and the offset is the newest label of each device: after a restart from a checkpoint,
the watch goes on behind it. A device's labels grow with time, as it has one writer, so a label at or before the
offset is never delivered again: a repeated file comes once, and a file put there late is no rotation (a replay or a fold of
the folder finds it). The offsets are found by listing; no file is opened. ``entries`` decodes the segments in tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from palimpsest.runtime import prepare
from palimpsest.sources import logformat
from palimpsest.sources.files import list_segment_files, system_of
from palimpsest.sources.pull import Pull, read_entries, read_header

NAME = "blocklog_rotations"
SCHEMA = "type string, dev_index int, label string, dir string, path string, bytes long"
#: Events of a batch at most.
BATCH = 64


def _devices(options) -> dict[str, str]:
    if "devices" in options:
        return {str(k): v for k, v in json.loads(options["devices"]).items()}
    if "path" not in options:
        raise ValueError("give a folder, or devices as a JSON map of index to folder")
    return {options.get("dev_index", "0"): options["path"]}


def rotated(devices: dict[str, str], after: dict[str, str], limit: int | None = None) -> tuple[list[tuple], dict[str, str]]:
    """Events behind the labels ``after``, in order, and the labels behind them."""
    found = [(label, int(dev), folder, path, size) for dev, folder in devices.items() for label, path, size in list_segment_files(folder) if label > after.get(dev, "")]
    taken = sorted(found)[:limit]
    upto = dict(after)
    for label, dev, *_ in taken:
        upto[str(dev)] = label
    return [("log_rotated", dev, label, folder, path, size) for label, dev, folder, path, size in taken], upto


class History(DataSourceReader):
    """All segments there are, for a batch read (seeding from history)."""

    def __init__(self, options):
        self.devices = _devices(options)

    def partitions(self):
        return [InputPartition(item) for item in self.devices.items()] or [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value is not None:
            dev, folder = partition.value
            yield from rotated({dev: folder}, {})[0]


class Watch(SimpleDataSourceStreamReader):
    """Names of segments alone pass the driver; their content is read in tasks."""

    def __init__(self, options):
        self.devices, self.limit = _devices(options), int(options.get("segments_per_batch", BATCH))
        if self.limit < 1:
            raise ValueError("a batch takes one segment at least")
        self.start = json.loads(options.get("after", "{}"))

    def initialOffset(self) -> dict:
        return {str(k): v for k, v in self.start.items()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = rotated(self.devices, start, self.limit)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch once more after a failure: the same events, as far as the files are still there."""
        rows, _ = rotated(self.devices, start)
        return iter([r for r in rows if r[2] <= end.get(str(r[1]), "")])


class Rotations(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return History(self.options)

    def simpleStreamReader(self, schema):
        return Watch(self.options)


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.dataSource.register(Rotations)


def _loaded(reader, devices: dict[int, str]):
    return reader.format(NAME).option("devices", json.dumps({str(k): v for k, v in devices.items()}))


def history(spark: SparkSession, devices: dict[int, str]) -> DataFrame:
    """The segments that are there, as events."""
    register(spark)
    return _loaded(spark.read, devices).load()


def watch(spark: SparkSession, devices: dict[int, str], segments_per_batch: int = BATCH, after: dict[int, str] | None = None) -> DataFrame:
    """A stream of rotation events of devices' folders, behind the labels ``after``."""
    register(spark)
    return _loaded(spark.readStream, devices).option("segments_per_batch", segments_per_batch).option("after", json.dumps({str(k): v for k, v in (after or {}).items()})).load()


ENTRY_COLUMNS = ["segment", "entry_index", "op", "timestamp_ns", "sequence", "block", "length", "block_size", "compressed_size", "data_offset"]


def entries(events: DataFrame) -> DataFrame:
    """``dev_index`` and the entries' geometry of each event's segment (batch or stream), as far as it can be read; a file that is gone gives none."""
    prepare(events.sparkSession)
    schema = T.StructType([T.StructField("dev_index", T.IntegerType()), *(logformat.SCHEMA[c] for c in ENTRY_COLUMNS)])
    arrow = pa.schema([("dev_index", pa.int32()), *((c, pa.string() if logformat.SCHEMA[c].dataType == T.StringType() else pa.int64()) for c in ENTRY_COLUMNS)])

    def run(batches):
        for batch in batches:
            for dev, label, folder, path, size in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                try:
                    with system_of(folder)[0].open_input_file(path) as f:
                        pull = Pull(f, size)
                        header = read_header(pull)
                        for i, e in enumerate(read_entries(pull, payload=False)):
                            rows.append({**{c: e.get(c) for c in ENTRY_COLUMNS}, "dev_index": dev, "segment": label, "entry_index": i, "block_size": header["block_size"]})
                            if len(rows) == 1024:
                                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                                rows = []
                except (ValueError, OSError):
                    pass  # what precedes the damage counts
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return events.select("dev_index", "label", "dir", "path", "bytes").repartition(F.col("label"), F.col("dev_index")).mapInArrow(run, schema)


def follow(spark: SparkSession, folder: str, map_path: str, checkpoint: str, segments_per_batch: int = BATCH, zone_blocks: int | None = None, **trigger):
    """Fold a folder's segments into a stored live map (``LiveMap``) as they are rotated, in log order. Returns the running query.

    A batch opens its own segments alone and writes the zones that they touch. A batch that is run again folds the same once more, which changes nothing.
    """
    from palimpsest.operators.livestore import LiveMap
    from palimpsest.sources import payload

    live = LiveMap(spark, map_path, *([] if zone_blocks is None else [zone_blocks]))

    def fold(batch: DataFrame, _: int) -> None:
        labels = sorted(r["label"] for r in batch.select("label").distinct().collect())  # a batch's segments
        if labels:
            live.fold(payload.index(spark, folder, segments=labels, mode="PERMISSIVE"), labels[-1])

    return watch(spark, {0: folder}, segments_per_batch).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def drain(query) -> None:
    """Let a query work off what is there, batch by batch, and stop it. (``availableNow`` ends after one batch of this source.)"""
    query.processAllAvailable()
    query.stop()

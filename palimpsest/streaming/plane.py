"""Continuous operation: streams of log segments and events with Structured Streaming.

File streams do not deliver segments by label, so the state keeps the newest version of each block
and merges by maximum: order and redelivery do not matter. Trims stay as rows, or a late older
write would come back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palimpsest.functions.labels import label_from_path
from palimpsest.operators import image, jobs
from palimpsest.operators.intervals import lookup
from palimpsest.operators.jobs import upload
from palimpsest.operators.overlay import apply
from palimpsest.runtime import prepare, stored
from palimpsest.sources import blocklog, payload, state
from palimpsest.sources.cbor import dumps, loads

#: Keys of control messages and events.
COMMAND_KEYS = {"cmd": 1, "dev": 2, "path": 3}
EVENT_KEYS = {1: "type", 2: "dev_index", 3: "label", 4: "dir", 5: "seq", 6: "device_size"}
MISS_KEYS = {1: "type", 2: "dev_index", 3: "cluster_index"}
MAX_RETRIES = 3


def command(cmd: str, dev: int | None = None, path: str | None = None) -> bytes:
    """A control message: watch, manage_misses, continue, retry or swap."""
    values = {"cmd": cmd, "dev": dev, "path": path}
    return dumps({COMMAND_KEYS[k]: v for k, v in values.items() if v is not None})


def event(content: bytes) -> dict:
    """A rotation or miss event, by its type."""
    raw = loads(content)[0]
    keys = MISS_KEYS if "miss" in str(raw.get(1)) else EVENT_KEYS
    return {name: raw.get(k) for k, name in keys.items()}


def segment_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New segments of a folder as they appear, payloads left out: a streaming DataFrame of entries."""
    prepare(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.log").option("maxFilesPerTrigger", files_per_trigger).load(folder)

    def run(batches):
        kinds = {"string": pa.string(), "bigint": pa.int64()}
        arrow = pa.schema([(f.name, kinds.get(f.dataType.simpleString(), pa.binary())) for f in blocklog.ENTRY_SCHEMA])
        for batch in batches:
            for segment, content in zip(*batch.columns):
                header, entries = blocklog.decode(content.as_py(), payload=False, strict=False)
                rows = [{"segment": segment.as_py(), "entry_index": i, "block_size": header["block_size"], **e} for i, e in enumerate(entries)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select(label_from_path(F.col("path")).alias("segment"), "content").mapInArrow(run, blocklog.ENTRY_SCHEMA)


def maintain_live_map(spark: SparkSession, folder: str, state_path: str, checkpoint: str, **trigger):
    """Fold arriving segments into a saved live map, batch by batch. Returns the running query."""

    def fold(batch: DataFrame, _: int) -> None:
        saved = state.load(spark, state_path)
        empty = spark.createDataFrame([], "version struct<segment:string,entry_index:bigint>, segment string, op string, start bigint, blocks bigint")
        state.save(apply(empty if saved is None else saved, blocklog.versioned(batch)), state_path)

    return segment_stream(spark, folder).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rotations(events: DataFrame, dev: int | None = None) -> DataFrame:
    """Rotation events (batch or stream), of one device or all."""
    return events if dev is None else events.where(F.col("dev_index") == dev)


def rotate(entries: DataFrame, size_limit: int, seconds: int = 60) -> DataFrame:
    """``entries`` with ``part``: the segment of its device's log that each goes to.

    An entry that brings the open segment to ``size_limit`` bytes (``bytes``) ends it, and an entry
    that comes ``seconds`` after the open segment began starts the next. A segment begins where the
    one before ends, or with its first entry. The rule follows a device's entries in order, as the
    writer of its log does; a task streams through them and holds one device's state.
    """
    prepare(entries.sparkSession)
    names = [c for c in entries.columns if c != "part"]
    ordered = entries.select(*names).repartition("dev_index").sortWithinPartitions("dev_index", "sequence")

    def run(batches):
        dev, part, held, began = None, 0, 0, None
        for batch in batches:
            columns = [batch.column(names.index(c)).to_pylist() for c in ("dev_index", "timestamp_ns", "bytes")]
            parts = []
            for d, at, size in zip(*columns):
                if d != dev:
                    dev, part, held, began = d, 0, 0, None
                if began is not None and held and at - began >= seconds * 1_000_000_000:
                    part, held, began = part + 1, 0, at
                began = at if began is None else began
                parts.append(part)
                held += size
                if held >= size_limit:
                    part, held, began = part + 1, 0, at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], names=[*names, "part"])

    return ordered.mapInArrow(run, T.StructType([*(entries.schema[c] for c in names), T.StructField("part", T.LongType())]))


def resolve_misses(misses: DataFrame, extents: DataFrame, cluster_blocks: int) -> DataFrame:
    """The log extents that fill each missed cluster (``dev_index, cluster_index``); clusters without any get null."""
    asked = misses.select("cluster_index").distinct().withColumn("q_lo", F.col("cluster_index") * cluster_blocks).withColumn("q_hi", (F.col("cluster_index") + 1) * cluster_blocks)
    found = lookup(extents, asked, width=cluster_blocks)
    return misses.join(found.drop("q_lo", "q_hi"), "cluster_index", "left")


def filled_clusters(spark: SparkSession, misses: DataFrame, folder: str, base: DataFrame, cluster_blocks: int) -> DataFrame:
    """``cluster, data`` of the missed clusters that the log has blocks of: the base's cluster (or zeros) with those blocks in place.

    Only the live map's zones of these clusters are looked at, and only the payloads that fill them are read.
    """
    block_size = jobs.header_of(spark, folder)["block_size"]
    live = jobs.stored_map(spark, folder)
    asked = misses.select("cluster_index").distinct().select(F.col("cluster_index").alias("cluster"), (F.col("cluster_index") * cluster_blocks).alias("q_lo"), ((F.col("cluster_index") + 1) * cluster_blocks).alias("q_hi"))
    zone = lambda c: F.floor(c / live.zone_blocks).cast("long")
    zones = [r["z"] for r in asked.select(F.explode(F.sequence(zone(F.col("q_lo")), zone(F.col("q_hi") - 1))).alias("z")).distinct().collect()]  # of a batch of misses
    met = lookup(live.at(zones).where("op = 'W'"), asked, width=cluster_blocks).select("cluster", "version", "segment", "op", "start", "blocks")
    near = payload.located(met, folder).repartition("segment").sortWithinPartitions("segment", "entry_index", "start")
    pieces = stored(payload.fetch(near, folder).select("cluster", (F.col("start") * block_size).alias("offset"), "length", "data"), "pieces")
    under = base.join(pieces.select("cluster").distinct(), "cluster", "left_semi").select("cluster", "data")
    return image.from_pieces(pieces.drop("cluster"), under, cluster_blocks * block_size)


def fill_misses(spark: SparkSession, misses: DataFrame, folder: str, base_path: str, cluster_blocks: int = 16) -> DataFrame:
    """Fill the base (a saved table of ``cluster, data``) from the log for missed clusters; ``dev_index, cluster_index, answer`` for each miss.

    The base is published before the answers, so a retry finds its data. A cluster that the log knows
    nothing of is answered with ``continue``: it reads zeros. New segments are folded into the stored live map first.
    """
    jobs.catch_up(spark, folder, blocklog.list_segments(spark, folder))
    empty = spark.createDataFrame([], "cluster long, data binary")
    saved = state.load(spark, base_path)
    base = empty if saved is None else saved
    made = stored(filled_clusters(spark, misses, folder, base, cluster_blocks), "filled")
    state.save(base.join(made.select("cluster"), "cluster", "left_anti").select("cluster", "data").unionByName(made), base_path)
    found = made.select(F.col("cluster").alias("cluster_index"), F.lit("retry").alias("answer"))
    return misses.join(found, "cluster_index", "left").select("dev_index", "cluster_index", F.coalesce("answer", F.lit("continue")).alias("answer"))


def serve_misses(spark: SparkSession, events: DataFrame, folder: str, base_path: str, answers: str, checkpoint: str, cluster_blocks: int = 16, **trigger):
    """Answer a stream of miss events (``dev_index, cluster_index``) batch by batch, into Parquet at ``answers``. Returns the running query."""

    def serve(batch: DataFrame, n: int) -> None:
        fill_misses(spark, batch, folder, base_path, cluster_blocks).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{answers}/batch={n}")

    return events.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def swap_base(clusters: DataFrame, base_path: str) -> None:
    """Put a new base (``cluster, data``) in the old one's place: readers that load it from now on see the new one, whole."""
    state.save(clusters.select("cluster", "data"), base_path)


def upload_stream(spark: SparkSession, folder: str, store: str, prefix: str, volume: str, checkpoint: str, **trigger):
    """Copy each new segment of a folder to a store once; a failed batch is tried again. Returns the running query."""

    def send(batch: DataFrame, _: int) -> None:
        upload(spark, folder, store, prefix, volume, [r["segment"] for r in batch.select("segment").distinct().collect()])  # a batch's files

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.log").option("maxFilesPerTrigger", 64).load(folder)
    return files.select(label_from_path(F.col("path")).alias("segment")).writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def answer(resolved: int, tries: int) -> str:
    """Retry a miss that data was found for, three times at most; else let it read zeros."""
    return "retry" if resolved and tries < MAX_RETRIES else "continue"

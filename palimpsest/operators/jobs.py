"""Whole jobs over log folders: garbage collection, repack, scans, replay, checksum, upload, size limit."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from palimpsest.functions.checks import crc_valid
from palimpsest.functions.labels import label_of
from palimpsest.operators import changes, compact, image, liveness, replay
from palimpsest.operators import upload as uploads
from palimpsest.operators.livestore import LiveMap
from palimpsest.operators.numbering import numbered, parts_of
from palimpsest.runtime import stored
from palimpsest.sources import blocklog, imagefile, imagewriter, logformat, payload, state
from palimpsest.sources.files import list_segment_files, system_of
from palimpsest.sources.pull import Pull, read_header

#: Fixed value: bytes of a segment before the next one begins.
SEGMENT_BYTES = 64 << 20


@dataclass
class GcResult:
    stats: list = field(default_factory=list)
    retired: list[str] = field(default_factory=list)
    new_segment: str = ""
    new_segments: list[str] = field(default_factory=list)
    copied_entries: int = 0
    copied_bytes: int = 0
    deleted: int = 0


def stored_map(spark: SparkSession, folder: str) -> LiveMap:
    """The folder's live map, as far as it was folded."""
    return LiveMap(spark, f"{folder}/.zones")


def catch_up(spark: SparkSession, folder: str, labels: list[str]) -> None:
    """Fold the segments behind the map's newest label into the stored map and totals; older files are not opened."""
    kept = stored_map(spark, folder)
    mark = kept.label()
    if not labels or mark is not None and labels[-1] <= mark:
        return
    new = payload.index(spark, folder, after=mark)
    keep_totals(spark, folder, new)  # first: a run that fails between the two adds the same rows again
    kept.fold(new, labels[-1])


def keep_totals(spark: SparkSession, folder: str, new: DataFrame) -> None:
    """Add the totals of new segments' entries to the stored ones; a segment counts once."""
    before, totals = state.load(spark, f"{folder}/.totals"), liveness.segment_totals(new)
    state.save(totals if before is None else before.join(totals.select("segment"), "segment", "left_anti").unionByName(totals), f"{folder}/.totals")


def live_map(spark: SparkSession, folder: str, full: bool = False) -> DataFrame:
    """The live map of a folder: the stored one with newer segments folded in, vanished segments left out; ``full`` derives it from the log alone."""
    labels = blocklog.list_segments(spark, folder)
    if full:
        rows = payload.live_ranges(payload.index(spark, folder))
    else:
        catch_up(spark, folder, labels)
        rows = stored_map(spark, folder).extents()
    listed = spark.createDataFrame([(s,) for s in labels], "segment string")
    return rows.join(listed, "segment", "left_semi").select("version", "segment", "op", "start", "blocks")


def header_of(spark: SparkSession, folder: str, include_tmp: bool = False) -> dict:
    """The header of the folder's first segment; no other file is opened."""
    files = list_segment_files(folder, include_tmp)
    if not files:
        raise FileNotFoundError(f"no .log files in {folder}")
    with system_of(folder)[0].open_input_file(files[0][1]) as f:
        return read_header(Pull(f, files[0][2]))


def _label_after(label: str) -> str:
    """One nanosecond later for a time label; for any other, the label with a suffix that sorts behind it."""
    try:
        return compact.next_label(label)
    except ValueError:
        return label + "~"


def write_ranges(spark: SparkSession, ranges: DataFrame, source: str, out: str, first_label: str, header: dict, segment_bytes: int = SEGMENT_BYTES) -> list[str]:
    """Copy live ranges (``payload.live_ranges``) of ``source`` to new segments in ``out``, in log order; the segments' labels, from ``first_label`` on.

    Rows are numbered and dealt to segments by their geometry. Each task that writes a segment reads its payloads from the
    source's files, so payloads pass neither the driver nor a shuffle. A segment's payload goes beyond half of
    ``segment_bytes`` by its last entry alone.
    """
    weight = F.when(F.col("op") == "W", F.col("blocks") * F.col("block_size")).otherwise(0)
    placed = parts_of(numbered(ranges, ["segment"], ["entry_index", "start"], weight), max(1, segment_bytes // 2))
    placed = stored(placed, "numbered")
    parts = sorted(r["part"] for r in placed.select("part").distinct().collect())  # a row a segment to be
    labels: list[str] = []
    for _ in parts:
        labels.append(_label_after(labels[-1]) if labels else first_label)
    named = spark.createDataFrame(list(zip(parts, labels)), "part long, to string")
    ordered = placed.join(named, "part").repartition("to").sortWithinPartitions("to", "sequence")
    ready = payload.fetch(ordered, source).select(F.col("to").alias("segment"), "op", "timestamp_ns", "sequence", F.col("start").alias("block"), "length", "data", F.when(F.col("op") == "W", F.crc32("data")).alias("checksum"))
    system, root = system_of(out)
    system.create_dir(root, recursive=True)
    logformat.register(spark)
    ready.write.format(logformat.NAME).options(block_size=header["block_size"], device_size=header["device_size"] or 0, backing_path=header["backing_path"] or "").mode("append").save(out)
    return labels


def gc(spark: SparkSession, folder: str, threshold: float = 50.0, dry_run: bool = False, timestamp_ns: int | None = None, segment_bytes: int = SEGMENT_BYTES) -> GcResult:
    """Retire segments below the threshold: copy what is live of them to new segments, then delete them.

    The new labels follow the newest processed one, so that replay applies the copies in its place; live ranges touch no block
    twice, so their order does not matter. The state of the analysis is kept in dry runs too.
    """
    labels = blocklog.list_segments(spark, folder)
    if not labels:
        raise FileNotFoundError(f"no .log files in {folder}")
    header = header_of(spark, folder)
    rows = stored(live_map(spark, folder), "livemap")
    listed = spark.createDataFrame([(s,) for s in labels], "segment string")
    totals = state.load(spark, f"{folder}/.totals").join(listed, "segment", "left_semi")
    stats = liveness.segment_stats(totals, rows, header["block_size"])
    result = GcResult(stats=stats.orderBy("segment").collect())  # a row a segment
    result.retired = [r["segment"] for r in liveness.retire_candidates(stats, threshold).select("segment").orderBy("segment").collect()]
    if not result.retired or dry_run:
        return result
    now = time.time_ns() if timestamp_ns is None else timestamp_ns
    gone = spark.createDataFrame([(x,) for x in result.retired], "segment string")
    moved = stored(payload.located(rows.join(gone, "segment", "left_semi"), folder).withColumn("timestamp_ns", F.lit(now)), "retired")
    sums = moved.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("op") == "W", F.col("blocks") * header["block_size"])), F.lit(0)).alias("b")).first()
    result.copied_entries, result.copied_bytes = sums["n"], sums["b"]
    if result.copied_entries:
        result.new_segments = write_ranges(spark, moved, folder, folder, _label_after(labels[-1]), header, segment_bytes)
        result.new_segment = result.new_segments[-1]
        catch_up(spark, folder, blocklog.list_segments(spark, folder))  # the copies hide what they were made of
    blocklog.delete_segments(spark, folder, result.retired)
    result.deleted = len(result.retired)
    return result


def repack(spark: SparkSession, folder: str, out: str, label: str, segment_bytes: int = SEGMENT_BYTES) -> list[str]:
    """All live ranges of a folder's log as new segments in ``out``, in log order; trims and times are kept. The segments' labels."""
    header = header_of(spark, folder)
    return write_ranges(spark, payload.live_ranges(payload.index(spark, folder)), folder, out, label, header, segment_bytes)


def replay_flat(spark: SparkSession, folder: str, out: str, incremental: bool = False, include_tmp: bool = True, verify: bool = True) -> dict:
    """Replay a folder into a flat file; incremental runs apply segments after the last label, set only on success.

    The overlay runs on geometry, and only what is alive is read. ``verify`` reads all entries once more to count wrong
    checksums; without it, ``crc_errors`` is null.
    """
    mark = (state.get_label(spark, f"{folder}/.labels", "last_replayed_label") if incremental else "") or None
    header = header_of(spark, folder, include_tmp)
    index = payload.index(spark, folder, after=mark, include_tmp=include_tmp, mode="PERMISSIVE")
    if verify:
        log = logformat.read(spark, folder, ["segment", "op", "length", "checksum", "data"], "DROPMALFORMED", include_tmp, mark)
        counters = liveness.replay_counters(log.withColumn("ok", crc_valid(F.col("op"), F.col("data"), F.col("checksum"))), "ok").first().asDict()
    else:
        counters = liveness.replay_counters(index).first().asDict() | {"crc_errors": None}
    replay.write_flat(payload.live_pieces(index, folder), out, header["device_size"], incremental=mark is not None)
    if incremental:
        labels = blocklog.list_segments(spark, folder)
        if labels:
            state.set_label(spark, f"{folder}/.labels", "last_replayed_label", labels[-1])
    return counters


def log_checksum(spark: SparkSession, folder: str) -> str:
    """SHA-256 of the device's content; one task reads the live ranges in order and adds them up, as the hash is sequential."""
    header = header_of(spark, folder)
    return replay.checksum(payload.fetch(payload.live_ranges(payload.index(spark, folder)).repartition(1).sortWithinPartitions("start"), folder), header["block_size"], header["device_size"])


#: Blocks in which changes are numbered by one task.
SCAN_CELL = 1 << 18


def scan_runs(spark: SparkSession, runs: DataFrame, state_path: str, folder: str, label: str, device_size: int, timestamp_ns: int, segment_bytes: int = SEGMENT_BYTES) -> dict:
    """Write segments of what changed since the saved state, in order of blocks, from ``label`` on; they are published before the state is.

    The counters are observed in the pass that compares the runs.
    ``runs`` has ``run_index, run_bytes, sha256, is_zero, data``. Nothing is written when nothing changed.
    """
    saved = state.load(spark, state_path)
    before = saved if saved is not None else spark.createDataFrame([], "run_index long, sha256 string")
    compared = runs.join(before.withColumnRenamed("sha256", "prev_sha256"), "run_index", "left").withColumn("changed", F.col("prev_sha256").isNull() | (F.col("prev_sha256") != F.col("sha256")))
    write = F.col("changed") & ~F.col("is_zero")
    seen = Observation("scan")
    compared = compared.observe(seen, F.count(F.lit(1)).alias("total_runs"), F.count(F.when(write, 1)).alias("writes"), F.coalesce(F.sum(F.when(write, F.col("run_bytes"))), F.lit(0)).cast("long").alias("write_bytes"))
    classified = stored(compared.select("run_index", "run_bytes", "sha256", "is_zero", "changed", F.when(write, F.col("data")).alias("data")), "scan")  # the runs are evaluated here alone
    counters = dict(seen.get)
    trims = stored(changes.trim_islands(classified, span=-(-device_size // changes.RUN_BYTES)), "trims")
    counters["trims"] = trims.count()
    rows = changes.changed_writes(classified).select(F.lit("W").alias("op"), (F.col("run_index") * changes.RUN_BLOCKS).alias("block"), F.col("run_bytes").alias("length"), "data")
    rows = rows.unionByName(changes.trim_chunks(trims).select(F.lit("T").alias("op"), "block", "length"), allowMissingColumns=True)
    if counters["writes"] or counters["trims"]:
        cell = F.floor(F.col("block") / F.lit(SCAN_CELL)).cast("long")
        placed = parts_of(numbered(rows.withColumn("cell", cell), ["cell"], ["block"], F.coalesce(F.octet_length("data"), F.lit(0))), max(1, segment_bytes // 2))
        parts = sorted(r["part"] for r in placed.select("part").distinct().collect())  # a row a segment
        labels = [label]
        while len(labels) < len(parts):
            labels.append(_label_after(labels[-1]))
        named = spark.createDataFrame(list(zip(parts, labels)), "part long, segment string")
        ready = placed.join(named, "part").select("segment", "op", F.lit(timestamp_ns).cast("long").alias("timestamp_ns"), "sequence", "block", "length", "data", F.crc32("data").alias("checksum"))
        logformat.write_log(ready, folder, changes.BLOCK_SIZE, device_size)
    kept = before.join(classified.select("run_index"), "run_index", "left_anti")
    state.save(kept.unionByName(classified.select("run_index", "sha256")), state_path)
    return counters


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of a folder's segments."""
    return sum(size for _, _, size in blocklog.segment_files(spark, folder))


def enforce_limit(spark: SparkSession, folder: str, limit: int, delete: bool = True) -> list[str]:
    """Delete the oldest segments until the folder is within ``limit`` bytes, live or not; their labels. Without ``delete``, a report."""
    files = [(label, size) for label, _, size in blocklog.segment_files(spark, folder)]
    if not files:
        return []
    found = liveness.limit_victims(spark.createDataFrame(files, "name string, bytes long"), limit)
    victims = sorted(r["name"] for r in found.collect())
    if delete:
        blocklog.delete_segments(spark, folder, victims)
    return victims


def upload(spark: SparkSession, folder: str, store: str, prefix: str, volume: str, labels: list[str] | None = None) -> list[str]:
    """Copy segments (all, or those of ``labels``) to ``store`` under their keys, by many tasks; what is there already stays. The keys written; failures are left to the next call."""
    done = uploads.upload(spark, folder, store, prefix, volume, labels).where("error is null")
    return sorted(r["key"] for r in done.select("key").collect())  # a row a new segment


def scan_every(spark: SparkSession, device: str, folder: str, seconds: float, rounds: int | None = None) -> list[dict]:
    """Scan a device file at once and then every ``seconds``; ``rounds`` ends it. The counters of the rounds."""
    out: list[dict] = []
    while rounds is None or len(out) < rounds:
        began = time.time()
        ns = time.time_ns()
        size = os.path.getsize(device)
        out.append(scan_runs(spark, imagefile.read_runs(spark, device), f"{folder}/.hashes", folder, label_of(ns // 1_000_000_000, ns % 1_000_000_000), size, ns))
        if rounds is None or len(out) < rounds:
            time.sleep(max(0.0, seconds - (time.time() - began)))
    return out


def apply_to_image(spark: SparkSession, pieces: DataFrame, path: str, virtual_size: int | None = None, cluster_bits: int = 16) -> tuple[int, int]:
    """Write and trim pieces (``offset, length, data``; null data: zeros) in an image file, new or there already, which is replaced whole by a rename.

    Clusters are rebuilt, packed and written by the tasks. Returns written and zero clusters.
    """
    if os.path.exists(path):
        header = imagefile.header_of(spark, path)
        virtual_size, cluster_bits = header.virtual_size, header.cluster_bits
        base = imagefile.read_image(spark, path).select("cluster", "data")
    else:
        base = spark.createDataFrame([], "cluster long, data binary")
    made = imagewriter.write_clusters(image.from_pieces(pieces, base, 1 << cluster_bits), path, virtual_size, cluster_bits)
    return made["written"], made["zero"]


def replay_image(spark: SparkSession, folder: str, path: str, include_tmp: bool = True) -> tuple[int, int]:
    """Replay a folder into an image file, new or there already."""
    index = payload.index(spark, folder, include_tmp=include_tmp, mode="PERMISSIVE")
    return apply_to_image(spark, payload.live_pieces(index, folder).select("offset", "length", "data"), path, header_of(spark, folder, include_tmp)["device_size"])

"""Compaction: rewrite live ranges of all segments (repack) or of chosen ones (retire)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.intervals import lookup
from palimpsest.operators.overlay import live_extents, newest_runs, owners


def slice_payload(data, start, ref_block, blocks, block_size: int):
    """The bytes of ``blocks`` from ``start`` within an entry's payload that begins at ``ref_block``."""
    return F.substring(data, ((start - ref_block) * block_size + 1).cast("int"), (blocks * block_size).cast("int"))


def _rewritten(live: DataFrame, block_size: int) -> DataFrame:
    rows = live.withColumn("length", F.col("blocks") * block_size)
    if "data" in live.columns:
        rows = rows.withColumn("data", F.when(F.col("op") == "W", slice_payload(F.col("data"), F.col("start"), F.col("ref_block"), F.col("blocks"), block_size)))
        rows = rows.withColumn("checksum", F.when(F.col("op") == "W", F.crc32("data")))
    return rows


def repack(entries: DataFrame, block_size: int, plan: str = "auto") -> DataFrame:
    """Live ranges of all entries, trims and timestamps kept, payloads cut and checksums recomputed.

    Rows keep ``version`` and ``start`` as their order.
    """
    return _rewritten(live_extents(entries, plan), block_size)


def retire(entries: DataFrame, state: DataFrame, segments: list | DataFrame, block_size: int, timestamp_ns: int | None = None) -> DataFrame:
    """Live ranges of the chosen segments (a list, or a DataFrame of ``segment``): what their own newest entries still cover, within the state's extents of the same segment."""
    if not isinstance(segments, DataFrame):
        segments = entries.sparkSession.createDataFrame([(x,) for x in segments], entries.select("segment").schema)
    chosen = entries.join(segments, "segment", "left_semi")
    own = live_extents_per_segment(chosen)
    held = state.join(segments, "segment", "left_semi").select("segment", F.col("start").alias("q_lo"), (F.col("start") + F.col("blocks")).alias("q_hi"))
    live = lookup(own, held, keys=["segment"]).drop("q_lo", "q_hi")
    rows = _rewritten(live, block_size)
    return rows if timestamp_ns is None else rows.withColumn("timestamp_ns", F.lit(timestamp_ns))


def live_extents_per_segment(entries: DataFrame) -> DataFrame:
    """Shadow analysis within each segment on its own."""
    return newest_runs(entries, ["segment"]).drop("segment").join(owners(entries), "version")


def next_label(label: str) -> str:
    """The label one nanosecond after ``label``."""
    from palimpsest.functions.labels import label_of, split_label

    seconds, nanos = split_label(label)
    return label_of(seconds + (nanos + 1) // 1_000_000_000, (nanos + 1) % 1_000_000_000)

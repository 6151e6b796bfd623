"""Per-segment totals, utilization, and what to retire or delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def segment_totals(entries: DataFrame) -> DataFrame:
    """Entries and written bytes of each segment; bytes are lengths, trims write none."""
    known = entries.where(F.col("op").isin("W", "T"))
    return known.groupBy("segment").agg(F.count(F.lit(1)).alias("total_entries"), F.coalesce(F.sum(F.when(F.col("op") == "W", F.col("length"))), F.lit(0)).cast("long").alias("total_write_bytes"))


def segment_stats(totals: DataFrame, extents: DataFrame, block_size: int) -> DataFrame:
    """Totals with live bytes (writes), live extents (trims too) and utilization (1 where nothing was written)."""
    live = extents.groupBy("segment").agg(F.coalesce(F.sum(F.when(F.col("op") == "W", F.col("blocks") * block_size)), F.lit(0)).cast("long").alias("live_write_bytes"), F.count(F.lit(1)).alias("live_entries"))
    stats = totals.join(live, "segment", "left").na.fill(0, ["live_write_bytes", "live_entries"])
    share = F.when(F.col("total_write_bytes") == 0, F.lit(1.0)).otherwise(F.col("live_write_bytes").cast("double") / F.col("total_write_bytes").cast("double"))
    return stats.withColumn("utilization", share)


def retire_candidates(stats: DataFrame, threshold: float) -> DataFrame:
    """Segments strictly below ``threshold`` percent that wrote something; never the newest of several."""
    newest = stats.agg(F.max("segment").alias("newest"), F.count(F.lit(1)).alias("n"))
    low = (F.col("utilization") < threshold / 100) & (F.col("total_write_bytes") > 0)
    return stats.crossJoin(F.broadcast(newest)).where(low & ((F.col("segment") < F.col("newest")) | (F.col("n") == 1))).drop("newest", "n")  # one row beside each


def reclaimable(stats: DataFrame, threshold: float) -> DataFrame:
    """Bytes that retiring the candidates frees."""
    return retire_candidates(stats, threshold).agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum(F.col("total_write_bytes") - F.col("live_write_bytes")), F.lit(0)).cast("long").alias("reclaimable_bytes"))


def orphans(extents: DataFrame, listing: DataFrame) -> DataFrame:
    """Segments of the map that the listing lacks."""
    return extents.select("segment").distinct().join(listing, "segment", "left_anti")


def limit_victims(files: DataFrame, limit: int) -> DataFrame:
    """The oldest files (``name, bytes``) whose removal brings the total within ``limit``. A report; nothing is deleted."""
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    older = F.coalesce(F.sum("bytes").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file of a directory
    return files.withColumn("older", older).crossJoin(F.broadcast(total)).where(F.col("total") - F.col("older") > limit).select("name", "bytes")


def replay_counters(entries: DataFrame, crc_ok: str | None = None) -> DataFrame:
    """Entries, writes, trims, bytes of both, and checksum errors (counted, still applied)."""
    write, trim = F.col("op") == "W", F.col("op") == "T"
    bad = F.sum(F.when(~F.col(crc_ok), 1).otherwise(0)) if crc_ok else F.lit(0)
    return entries.agg(
        F.count(F.lit(1)).alias("entries"), F.count(F.when(write, 1)).alias("writes"), F.count(F.when(trim, 1)).alias("trims"),
        F.coalesce(F.sum(F.when(write, F.col("length"))), F.lit(0)).cast("long").alias("write_bytes"), F.coalesce(F.sum(F.when(trim, F.col("length"))), F.lit(0)).cast("long").alias("trim_bytes"), bad.cast("long").alias("crc_errors"),
    )

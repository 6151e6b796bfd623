"""Descriptions of log entries: geometry, sizes, checks, JSON and hexadecimal dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.checks import crc_valid
from palimpsest.functions.labels import format_size, utc_nanos


def described(entries: DataFrame, block_size: int) -> DataFrame:
    """Entries with kind, block range, byte range and size; with payload columns also ratio, checksum state and a preview."""
    kind = F.when(F.col("op") == "W", "WRITE").when(F.col("op") == "T", "TRIM").otherwise(F.concat(F.lit("UNKNOWN("), F.col("op"), F.lit(")")))
    n = F.floor(F.col("length") / block_size).cast("long")
    first = F.col("block") * block_size
    rows = entries.select("*", kind.alias("kind"), n.alias("n_blocks"), (F.col("block") + n - 1).alias("block_end"), first.alias("offset_start"), (first + F.col("length") - 1).alias("offset_end"), format_size(F.col("length")).alias("size"))
    if "timestamp_ns" in entries.columns:
        rows = rows.withColumn("time", utc_nanos(F.col("timestamp_ns")))
    if "compressed_size" in entries.columns:
        rows = rows.withColumn("reduction_percent", F.round((1 - F.col("compressed_size") / F.col("length")) * 100, 1))
    if "data" in entries.columns:
        rows = rows.withColumn("crc_ok", crc_valid(F.col("op"), F.col("data"), F.col("checksum"))).withColumn("preview", F.lower(F.hex(F.substring("data", 1, 64))))
    return rows


def as_json(rows: DataFrame, data_hex: bool = False) -> DataFrame:
    """One JSON text an entry; payloads go unless ``data_hex``."""
    columns = [F.lower(F.hex("data")).alias("data") if c == "data" else F.col(c) for c in rows.columns if c != "data" or data_hex]
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))

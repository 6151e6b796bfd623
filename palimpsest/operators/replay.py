"""Replay of a log into the latest state, flat files and checksums."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.compact import slice_payload
from palimpsest.operators.overlay import live_extents, newest_blocks
from palimpsest.runtime import prepare


def block_owners(entries: DataFrame) -> DataFrame:
    """``blk`` and the newest entry's ``version``, ``segment``, ``op``."""
    owner = entries.select("version", "segment", "op")
    return newest_blocks(entries.where(F.col("op").isin("W", "T"))).join(owner, "version")


def since(entries: DataFrame, watermark) -> DataFrame:
    """Entries of segments after the watermark (strict); all where there is none."""
    return entries if watermark is None else entries.where(F.col("segment") > watermark)


def pieces(entries: DataFrame, block_size: int) -> DataFrame:
    """``offset, length, data`` (null data: zeros) of the latest state, one row a live extent."""
    live = live_extents(entries)
    cut = slice_payload(F.col("data"), F.col("start"), F.col("ref_block"), F.col("blocks"), block_size)
    return live.select((F.col("start") * block_size).alias("offset"), (F.col("blocks") * block_size).alias("length"), F.when(F.col("op") == "W", cut).alias("data"))


def write_flat(pieces_: DataFrame, path: str, size: int, incremental: bool = False) -> int:
    """Write a flat image to a file that the tasks can open: each writes its pieces in place, in parallel. Returns the pieces.

    Pieces overlap nowhere, so a task that runs twice does no harm. Zeros go in bounded parts, and
    not at all into a new file, which is sparse.
    """
    with open(path, "r+b" if incremental else "wb") as f:
        f.truncate(size)

    def run(batches):
        n, zeros = 0, bytes(1 << 20)
        with open(path, "r+b") as f:
            for batch in batches:
                for offset, length, data in zip(*(c.to_pylist() for c in batch.columns)):
                    n += 1
                    f.seek(offset)
                    if data is not None:
                        f.write(data)
                    elif incremental:
                        for at in range(0, length, len(zeros)):
                            f.write(zeros[: min(len(zeros), length - at)])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    prepare(pieces_.sparkSession)
    return pieces_.select("offset", "length", "data").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def checksum(ranges: DataFrame, block_size: int, size: int) -> str:
    """SHA-256 of the virtual content, from ranges (``start, length, data``; null data: zeros) in one partition and in order; gaps are zeros.

    The hash is sequential by nature: one task streams through the rows, and only the digest comes to the driver.
    """

    def run(batches):
        h, at, zeros = hashlib.sha256(), 0, bytes(1 << 20)

        def fill(n: int) -> None:
            while n > 0:
                h.update(zeros[: min(n, len(zeros))])
                n -= len(zeros)

        for batch in batches:
            for start, length, data in zip(*(c.to_pylist() for c in batch.columns)):
                fill(start * block_size - at)
                h.update(data or b"")
                fill(length - len(data or b""))
                at = start * block_size + length
        fill(size - at)
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["sha256"])

    prepare(ranges.sparkSession)
    rows = ranges.select("start", "length", "data").mapInArrow(run, "sha256 string").collect()
    if len(rows) > 1:
        raise ValueError("ranges must be in one partition")
    return rows[0]["sha256"]

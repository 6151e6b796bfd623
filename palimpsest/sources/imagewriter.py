"""Image files written by many tasks: clusters are packed first, places come from running sums, then each task writes its own.

Three passes. The first packs the clusters and keeps their stored sizes. Sums of the sizes, table by table and, within a table, cell by
cell, give each cell of clusters its place in the file. The second writes the cells side by side; the third writes each level-two table with its
checksum. The driver writes the header and the level-one table and renames the file. A task that runs twice writes the same bytes to the
same places. The tasks must be able to open the path for writing in place.
"""

from __future__ import annotations

import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from palimpsest.functions.checks import crc32c, lz4_pack
from palimpsest.operators.image import parts_for
from palimpsest.runtime import Scratch, prepare
from palimpsest.sources.imagefile import ALIGN, PACKED, TRAILER, new_header

#: Clusters that one task places and writes in turn.
CELL = 512


def _packed(clusters: DataFrame, cluster: int) -> DataFrame:
    """``cluster, body, packed, size``: stored bytes, whether they are packed, and their aligned size; a cluster of zeros has no body."""

    def run(batches):
        for batch in batches:
            bodies, flags, sizes = [], [], []
            for data in batch.column(1).to_pylist():
                if len(data or b"") > cluster:
                    raise ValueError(f"a cluster of {len(data)} bytes; they have {cluster} at most")
                data = (data or b"").ljust(cluster, b"\0")
                if not data.strip(b"\0"):
                    bodies.append(None), flags.append(False), sizes.append(0)
                    continue
                body = lz4_pack(data)
                small = len(body) < cluster - 4
                bodies.append(struct.pack(">I", len(body)) + body if small else data)
                flags.append(small)
                sizes.append(-(-(4 + len(body)) // ALIGN) * ALIGN if small else cluster)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()), pa.array(flags, pa.bool_()), pa.array(sizes, pa.int64())], names=["cluster", "body", "packed", "size"])

    return clusters.select(F.col("cluster").cast("long").alias("cluster"), "data").mapInArrow(run, "cluster long, body binary, packed boolean, size long")


def write_clusters(clusters: DataFrame, path: str, virtual_size: int, cluster_bits: int = 16) -> dict:
    """Write ``cluster, data`` (each cluster once; null or zeros: left out) as an image file, new or in the place of an old one.

    Returns what was seen while packing: ``clusters, written, zero, packed, stored_bytes``.
    """
    spark: SparkSession = clusters.sparkSession
    prepare(spark)
    h, scratch = new_header(virtual_size, cluster_bits), Scratch(spark)
    last = h.l1_size * h.entries
    seen = Observation("image")
    body = F.col("body").isNotNull()
    rows = _packed(clusters, h.cluster).observe(
        seen, F.count(F.lit(1)).alias("clusters"), F.count(F.when(body, 1)).alias("written"), F.count(F.when(~body, 1)).alias("zero"), F.count(F.when(F.col("packed"), 1)).alias("packed"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"), F.coalesce(F.max(F.when(body, F.col("cluster"))), F.lit(0)).alias("last"),
    )
    cell = F.floor(F.col("cluster") % h.entries / CELL).cast("int")
    rows = scratch.stored(rows.where(body).withColumn("table", F.floor(F.col("cluster") / h.entries).cast("int")).withColumn("cell", cell), "packed")
    counters = dict(seen.get)
    if counters.pop("last") >= last:
        raise ValueError("a cluster beyond the image's size")
    cells = scratch.stored(rows.groupBy("table", "cell").agg(F.sum("size").alias("size")), "cells")
    tables = sorted((r["table"], r["size"]) for r in cells.groupBy("table").agg(F.sum("size").alias("size")).collect())  # a row a table: half a gigabyte each
    at, base, place = h.alloc_offset, {}, {}
    for table, size in tables:
        base[table] = at
        at += size
    at = -(-at // h.cluster) * h.cluster
    for table, _ in tables:
        place[table] = at
        at += h.cluster
    h.alloc_offset = at
    bases, places = spark.sparkContext.broadcast(base), spark.sparkContext.broadcast(place)
    temporary = f"{path}.tmp"
    with open(temporary, "wb") as f:
        f.truncate(at)

    before = F.coalesce(F.sum("size").over(Window.partitionBy("table").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = rows.repartition(parts_for(counters["stored_bytes"]), "table", "cell")
    placed = dealt.join(cells.select("table", "cell", before.alias("before")), ["table", "cell"]).sortWithinPartitions("table", "cell", "cluster")
    entries = h.entries

    def write(batches):
        cell, at = None, 0
        with open(temporary, "r+b") as f:
            for batch in batches:
                index, value = [], []
                for table, part, cluster, body, packed, size, before in zip(*(c.to_pylist() for c in batch.columns)):
                    if (table, part) != cell:
                        cell, at = (table, part), bases.value[table] + before
                    f.seek(at)
                    f.write(body)
                    index.append(cluster)
                    value.append(at - (1 << 63) if packed else at)  # the flag is the sign bit
                    at += size
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index, pa.int64()), pa.array(value, pa.int64())], names=["table", "cluster", "entry"])
            f.flush()
            os.fsync(f.fileno())

    written = scratch.stored(placed.select("table", "cell", "cluster", "body", "packed", "size", "before").mapInArrow(write, "table int, cluster long, entry long"), "entries")

    def table_of(group: pa.Table) -> pa.Table:
        table = group.column("table")[0].as_py()
        values = [0] * entries
        for cluster, entry in zip(group.column("cluster").to_pylist(), group.column("entry").to_pylist()):
            if values[cluster % entries]:
                raise ValueError(f"cluster {cluster} comes twice")
            values[cluster % entries] = entry % (1 << 64)
        raw = struct.pack(f">{entries}Q", *values) + b"\0" * (TRAILER - 4)
        with open(temporary, "r+b") as f:
            f.seek(places.value[table])
            f.write(raw + struct.pack(">I", crc32c(raw)))
            f.flush()
            os.fsync(f.fileno())
        return pa.table({"table": pa.array([table], pa.int32())})

    try:
        done = written.groupBy("table").applyInArrow(table_of, "table int").count()
        if done != len(tables):
            raise OSError(f"{done} of {len(tables)} tables were written")
        l1 = [0] * h.l1_size
        for table, offset in place.items():
            l1[table] = offset
        with open(temporary, "r+b") as f:
            f.write(h.encode() + struct.pack(f">{h.l1_size}Q", *l1))
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
        scratch.drop()
    return counters


def flat_file(spark: SparkSession, path: str, cluster: int) -> DataFrame:
    """``cluster, data`` of a flat file, read in ranges by tasks; the last may be short, and holes of the file are passed over."""
    prepare(spark)
    size = os.path.getsize(path)
    chunks = -(-size // (cluster * CELL))
    parts = max(1, min(8 * spark.sparkContext.defaultParallelism, chunks))

    def run(batches):
        with open(path, "rb") as f:
            for batch in batches:
                for chunk in batch.column(0).to_pylist():
                    at, end = chunk * cluster * CELL, min(size, (chunk + 1) * cluster * CELL)
                    index, data = [], []
                    while at < end:
                        try:
                            at = os.lseek(f.fileno(), at, os.SEEK_DATA) // cluster * cluster
                        except OSError:  # nothing but a hole behind
                            break
                        if at >= end:
                            break
                        f.seek(at)
                        index.append(at // cluster)
                        data.append(f.read(cluster))
                        at += cluster
                        if len(data) * cluster >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(data, pa.binary())], names=["cluster", "data"])
                            index, data = [], []
                    if data:
                        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(data, pa.binary())], names=["cluster", "data"])

    return spark.range(0, chunks, 1, parts).mapInArrow(run, "cluster long, data binary")


def convert(spark: SparkSession, source: str, path: str, cluster_bits: int = 16) -> dict:
    """A flat file as an image, sparse."""
    return write_clusters(flat_file(spark, source, 1 << cluster_bits), path, os.path.getsize(source), cluster_bits)


def compact(spark: SparkSession, source: str, path: str) -> dict:
    """An image without clusters of zeros and dead space; ``path`` may be the source itself."""
    from palimpsest.sources import imagefile

    h = imagefile.header_of(spark, source)
    counters = write_clusters(imagefile.read_image(spark, source), path, h.virtual_size, h.cluster_bits)
    return counters

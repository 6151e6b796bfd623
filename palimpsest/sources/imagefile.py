"""Cluster image files: a two-level table over clusters that are LZ4-packed where that saves space.

Reading gives cluster rows; writing takes them in order and makes a new file (images are immutable
here, so the format's free list stays empty). Tables carry a CRC-32C that reading verifies.
"""

from __future__ import annotations

import errno
import hashlib
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions.checks import crc32c, lz4_pack, lz4_unpack
from palimpsest.runtime import prepare

#: Fixed values of the format.
MAGIC, FORMAT, HEADER_SIZE, LZ4 = 0x4C42444351573200, 2, 4096, 1
PACKED, OFFSET, ALIGN, TRAILER = 1 << 63, 0x3FFFFFFFFFFFFFFF, 4096, 8


@dataclass
class Header:
    cluster_bits: int
    virtual_size: int
    l1_offset: int
    l1_size: int
    alloc_offset: int
    free_list: int = 0

    @property
    def cluster(self) -> int:
        return 1 << self.cluster_bits

    @property
    def entries(self) -> int:
        return (self.cluster - TRAILER) // 8

    def encode(self) -> bytes:
        return struct.pack(">QIIQQIQIQ", MAGIC, FORMAT, self.cluster_bits, self.virtual_size, self.l1_offset, self.l1_size, self.alloc_offset, LZ4, self.free_list).ljust(HEADER_SIZE, b"\0")

    @classmethod
    def decode(cls, data: bytes) -> "Header":
        magic, version, bits, size, l1, n, alloc, packing, free = struct.unpack_from(">QIIQQIQIQ", data)
        if magic != MAGIC or version != FORMAT or packing != LZ4:
            raise ValueError("not a cluster image of this version")
        return cls(bits, size, l1, n, alloc, free)


def new_header(virtual_size: int, cluster_bits: int = 16) -> Header:
    if not 12 <= cluster_bits <= 24:
        raise ValueError("cluster bits must be between 12 and 24")
    h = Header(cluster_bits, virtual_size, HEADER_SIZE, 0, 0)
    h.l1_size = max(1, -(-virtual_size // (h.entries * h.cluster)))
    h.alloc_offset = -(-(HEADER_SIZE + 8 * h.l1_size) // h.cluster) * h.cluster
    return h


def write_image(path: str, clusters: Iterable[tuple[int, bytes]], virtual_size: int, cluster_bits: int = 16) -> tuple[int, int]:
    """Write clusters (index, data) to a local image file; zero clusters are left out. Returns written and zero clusters."""
    h = new_header(virtual_size, cluster_bits)
    tables: dict[int, list[int]] = {}
    written = zero = 0
    with open(path, "wb") as f:
        at = h.alloc_offset
        for index, data in clusters:
            data = bytes(data).ljust(h.cluster, b"\0")
            if not any(data):
                zero += 1
                continue
            packed = lz4_pack(data)
            f.seek(at)
            if len(packed) < h.cluster - 4:
                f.write(struct.pack(">I", len(packed)) + packed)
                entry, size = PACKED | at, -(-(4 + len(packed)) // ALIGN) * ALIGN
            else:
                f.write(data)
                entry, size = at, h.cluster
            tables.setdefault(index // h.entries, [0] * h.entries)[index % h.entries] = entry
            at += size
            written += 1
        l1 = [0] * h.l1_size
        for i, table in sorted(tables.items()):
            raw = struct.pack(f">{h.entries}Q", *table) + b"\0" * (TRAILER - 4)
            f.seek(at)
            f.write(raw + struct.pack(">I", crc32c(raw)))
            l1[i] = at
            at += h.cluster
        h.alloc_offset = at
        f.seek(0)
        f.write(h.encode() + struct.pack(f">{h.l1_size}Q", *l1))
        f.truncate(at)
    return written, zero


def _clusters(h: Header, i: int, raw: bytes, first: int, last: int, read) -> Iterator[tuple[int, int, bool, bytes]]:
    """``cluster, offset, packed, data`` of the allocated clusters of table ``i`` from ``first`` to ``last``."""
    if struct.unpack_from(">I", raw, h.cluster - 4)[0] != crc32c(raw[:-4]):
        raise ValueError(f"CRC32C mismatch in table {i}")
    for j in range(first, last):
        entry = struct.unpack_from(">Q", raw, 8 * j)[0]
        if entry:
            where = entry & OFFSET
            if entry & PACKED:
                n = struct.unpack(">I", read(where, 4))[0]
                body = lz4_unpack(read(where + 4, n), h.cluster)
                if len(body) != h.cluster:
                    raise ValueError(f"cluster {i * h.entries + j} has {len(body)} bytes")
            else:
                body = read(where, h.cluster)
            yield i * h.entries + j, where, bool(entry & PACKED), body


def clusters_of(data: bytes) -> Iterator[tuple[int, int, bool, bytes]]:
    """``cluster, offset, packed, data`` of the allocated clusters of an image in memory."""
    h = Header.decode(data)
    for i, at in enumerate(struct.unpack_from(f">{h.l1_size}Q", data, h.l1_offset)):
        if at:
            yield from _clusters(h, i, data[at : at + h.cluster], 0, h.entries, lambda where, n: data[where : where + n])


#: Clusters that one task reads at a time.
CHUNK = 512


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, phys_offset, packed, data`` of an image file of any size.

    The header and the level-one table are read by the driver; ranges of clusters are dealt over
    tasks, which seek to their table, verify it and read their clusters. The tasks must be able to
    open the path (``pyarrow.fs``).
    """
    prepare(spark)
    h = header_of(spark, path)
    system, root = _opened(path)
    with system.open_input_file(root) as f:
        f.seek(h.l1_offset)
        l1 = struct.unpack(f">{h.l1_size}Q", f.read(8 * h.l1_size))
    chunks = -(-h.entries // CHUNK)
    ranges = spark.createDataFrame([(i, at) for i, at in enumerate(l1) if at], "i long, at long")
    ranges = ranges.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(max(1, min(8 * spark.sparkContext.defaultParallelism, chunks * sum(map(bool, l1)))))

    def run(batches):
        files, inner = _opened(path)
        with files.open_input_file(inner) as f:
            for batch in batches:
                for i, at, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                    f.seek(at)
                    raw = f.read(h.cluster)
                    rows = []
                    for row in _clusters(h, i, raw, chunk * CHUNK, min(h.entries, (chunk + 1) * CHUNK), lambda where, n: (f.seek(where), f.read(n))[1]):
                        rows.append(row)
                        if len(rows) == 64:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return ranges.select("i", "at", "chunk").mapInArrow(run, "cluster long, phys_offset long, packed boolean, data binary")


def _opened(path: str):
    return pa_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def _batch(rows: list) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.bool_()), pa.array(c[3], pa.binary())], names=["cluster", "phys_offset", "packed", "data"])


def header_of(spark: SparkSession, path: str) -> Header:
    f = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = f.getFileSystem(spark._jsc.hadoopConfiguration()).open(f)
    try:
        return Header.decode(bytes(stream.readNBytes(64)))
    finally:
        stream.close()


def flat_clusters(path: str, cluster_size: int, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """Clusters of a flat file, in order (conversion to an image)."""
    with open(path, "rb") as f:
        index = start
        while part := f.read(cluster_size):
            yield index, part
            index += 1


def create_image(path: str, virtual_size: int, cluster_bits: int = 16) -> None:
    """An image file without clusters."""
    write_image(path, [], virtual_size, cluster_bits)


def holes(path: str) -> Iterator[tuple[int, int]]:
    """Byte ranges of a local file without data, in order; none where the file system cannot tell."""
    size, at = os.path.getsize(path), 0
    with open(path, "rb") as f:
        while at < size:
            try:
                lo = os.lseek(f.fileno(), at, os.SEEK_HOLE)
                if lo >= size:
                    return
                try:
                    at = os.lseek(f.fileno(), lo, os.SEEK_DATA)
                except OSError as e:
                    if e.errno != errno.ENXIO:
                        raise
                    at = size
            except OSError:
                return
            yield lo, at


def read_holes(spark: SparkSession, path: str) -> DataFrame:
    """``lo, hi`` of the holes of a device file (its map, not its data)."""
    return spark.createDataFrame(list(holes(path)), "lo long, hi long")


def read_runs(spark: SparkSession, path: str, run_bytes: int = 61_440, files_bytes: int | None = None) -> DataFrame:
    """``run_index, run_bytes, sha256, is_zero, data`` of fixed-size runs of a flat device file; the last may be short.

    The file is split at run edges over tasks, each of which reads its own range; a run inside a
    hole is zeros without being read.
    """
    prepare(spark)
    size = os.path.getsize(path) if files_bytes is None else files_bytes
    total = -(-size // run_bytes)
    names = ["run_index", "run_bytes", "sha256", "is_zero", "data"]

    def run(batches):
        zeros, data_at = bytes(run_bytes), -1
        zero_hash = hashlib.sha256(zeros).hexdigest()
        with open(path, "rb") as f:
            for batch in batches:
                rows = []
                for i in batch.column(0).to_pylist():
                    start, n = i * run_bytes, min(run_bytes, size - i * run_bytes)
                    if data_at < start:  # the next data from here on; asked once a hole
                        try:
                            data_at = os.lseek(f.fileno(), start, os.SEEK_DATA)
                        except OSError as e:
                            data_at = size if e.errno == errno.ENXIO else start
                    if data_at >= start + n and n == run_bytes:
                        rows.append((i, n, zero_hash, True, zeros))
                        continue
                    f.seek(start)
                    data = f.read(run_bytes)
                    rows.append((i, len(data), hashlib.sha256(data).hexdigest(), not any(data), data))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3]), pa.array(c[4], pa.binary())], names=names)

    return spark.range(total).mapInArrow(run, "run_index long, run_bytes long, sha256 string, is_zero boolean, data binary")

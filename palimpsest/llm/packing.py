"""Harmonic packing of token streams into fixed-capacity sequences (operator 10).

A document's ids are cut into whole sequences, then into exact unit fractions of the capacity
(a half, a quarter, an eighth), and a rest below an eighth. A piece of length ``l`` belongs to the
reciprocal class ``k = capacity // l``: a bin of that class takes exactly ``k`` pieces, so each
class fills its bins by counting, with no search. Every worker packs the partitions it reads on
its own: no shuffle, and memory holds one open bin a class. The open bins that remain at the end
of a partition are merged by first fit, at most one for each class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from palimpsest.llm.bytebpe import ChunkEncoder
from palimpsest.runtime import prepare

CAPACITY = 1024
#: Sequence ids are partition * 2**33 + count within the partition.
ID_BITS = 33


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: whole sequences, unit fractions, one rest."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    part = capacity // 2
    while part >= max(1, capacity // 8):
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    if rest:
        out.append(rest)
    return out


class HarmonicPacker:
    """Bins of one partition; ``add`` and ``flush`` return finished bins as lists of pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def add(self, piece: tuple) -> list | None:
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        return self.open.pop(k) if len(bin_) == k else None

    def flush(self) -> list[list]:
        """First fit, longest first, of the pieces in open bins: each class has less than one bin."""
        pieces = sorted((p for b in self.open.values() for p in b), key=lambda p: -p[2])
        self.open = {}
        bins: list[list] = []
        room: list[int] = []
        for p in pieces:
            for i, r in enumerate(room):
                if p[2] <= r:
                    bins[i].append(p)
                    room[i] -= p[2]
                    break
            else:
                bins.append([p])
                room.append(self.capacity - p[2])
        return bins


def harmonic_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null or empty text: its end id alone. Repeated rows and null ids are packed as documents of
    their own. An empty table gives no rows. Only the two named columns are read; others are ignored. A very long text
    is encoded whole by one task, whose memory follows its length, and cut into pieces. Pieces of equal length go to their class's open
    bin in the order of their rows in a task.
    """
    prepare(docs.sparkSession)
    id_field = docs.schema[id_col]
    long = T.LongType()
    schema = T.StructType([T.StructField(id_col, id_field.dataType, True)] + [T.StructField(c, long, False) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = ChunkEncoder.load(tokenizer_path), HarmonicPacker(capacity)
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << ID_BITS
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kind = None

        def close(bin_: list) -> None:
            nonlocal next_id
            at = 0
            for doc, start, length, crc, total in bin_:
                rows.append((doc, start, length, crc, total, next_id, at))
                at += length
            next_id += 1

        def emit() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            kind = batch.column(0).type
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 128):
                for doc, body in zip(ids[a : a + 128], encoder.encode(texts[a : a + 128])):
                    body += end
                    total, start = len(body) // 4, 0
                    for length in cut(total, capacity):
                        crc = zlib.crc32(body[4 * start : 4 * (start + length)])
                        if done := packer.add((doc, start, length, crc, total)):
                            close(done)
                        start += length
            if rows:
                yield emit()
        for bin_ in packer.flush():
            close(bin_)
        if rows:
            yield emit()

    return docs.select(docs[id_col], docs[text_col].cast("string").alias("__text")).mapInArrow(run, schema)

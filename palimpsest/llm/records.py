"""Length-delimited token records with a separate offset index (operator 8).

One record: payload length (8 bytes), masked checksum of those 8 bytes (4), payload, masked
checksum of the payload (4), a line feed. The payload is an id flag (1 byte), the document id
(8 bytes) and the token ids as unsigned 16 or 32-bit integers; all numbers are little-endian. The
mask rotates a CRC-32 right by 15 bits and adds a constant, so that checksums of data that holds
checksums stay sound. The line feed is what Spark's line writer puts after each row: the files are
written by its text sink, in any file system that Spark knows and under its commit protocol.

``write_records`` encodes first, so only framed ids are shuffled, once, to parts by ranges of ids; so
files in order hold ascending ids. It bounds the bytes of a file. ``build_index`` scans the files
once, verifies each checksum and keeps (file, id, byte offset, length, tokens) as Parquet;
``read_records`` reads any subset of records, in any order, through that index: it seeks to each
record where the file system can be opened from Python, and else reads the files that hold one.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from palimpsest.llm.batches import Buckets
from palimpsest.llm.bytebpe import ChunkEncoder
from palimpsest.runtime import prepare, scratch_path

MASK = 0xA282EAD8
#: Bytes of a file about: one record more at most.
FILE_BYTES = 32 << 20
HEAD, FOOT = 12, 5


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A record without its line feed; ``ids`` are little-endian unsigned 32-bit integers. ValueError for an id that the width cannot hold."""
    if width == 4:
        body = ids
    else:
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) > 0xFFFF:
            raise ValueError(f"id {int(numbers.max())} needs more than {width} bytes")
        body = numbers.astype("<u2").tobytes()
    payload = struct.pack("<BBq", doc_id is not None, width, doc_id or 0) + body
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def parse(data: bytes, offset: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The document id, token ids and next offset of the record at ``offset``; ValueError if damaged."""
    head = data[offset : offset + 8]
    if len(head) < 8 or masked_crc(head) != struct.unpack_from("<I", data, offset + 8)[0]:
        raise ValueError(f"damaged length at byte {offset}")
    size = struct.unpack("<Q", head)[0]
    payload = data[offset + HEAD : offset + HEAD + size]
    end = offset + HEAD + size
    if len(payload) < size or masked_crc(payload) != struct.unpack_from("<I", data, end)[0] or data[end + 4 : end + 5] != b"\n":
        raise ValueError(f"damaged record at byte {offset}")
    has_id, width, doc_id = struct.unpack_from("<BBq", payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=10), end + FOOT


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, id_width: int = 2) -> None:
    """Encode each text (null: empty), append ``end_id`` and write record files in ascending id order.

    Null ids come first; rows of equal id, repeated ones too, are all kept, in the order of a hash of
    the text. ``id_width`` is 2 for vocabularies up to 65,536 and 4 beyond; an id that does not fit is
    an error. Ids of documents are integers. A very long text is one record, whatever its size. An
    empty table gives no files; columns not named are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)).cast("long"))
    source = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("tie"), docs[text_col].cast("string").alias("text"), key.alias("key"))
    total = source.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-total["bytes"] // (2 * file_bytes)), min(4 * spark.sparkContext.defaultParallelism, total["n"] // 1024))  # ids take about half the bytes of a text
    buckets = Buckets.of(source.select("key"), "key", max(1, -(-total["n"] // parts)))
    source = source.select("id", "tie", "text", buckets(F.col("key"), F.col("tie")).alias("part"))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        encoder = ChunkEncoder.load(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(texts), 128):
                frames = [frame(i, b + end, id_width) for i, b in zip(ids[a : a + 128], encoder.encode(texts[a : a + 128]))]
                part = batch.slice(a, len(frames))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(frames, pa.binary())], names=["id", "tie", "part", "value"])

    framed = source.mapInArrow(encode, "id long, tie long, part int, value binary")

    def cut(batches):
        """A part beyond the bytes of a file (it holds long records) goes to several."""
        size = 0
        for batch in batches:
            pieces = []
            for n in pc.binary_length(batch.column(2)).to_pylist():
                pieces.append(size // file_bytes)
                size += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], names=["id", "tie", "value", "piece"])

    dealt = framed.repartitionById(buckets.count, F.col("part")).sortWithinPartitions("id", "tie").select("id", "tie", "value")
    placed = dealt.mapInArrow(cut, "id long, tie long, value binary, piece long").sortWithinPartitions("piece", "id", "tie")
    placed.select(F.col("value").cast("string").alias("value"), "piece").write.option("compression", "none").partitionBy("piece").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (its folder and name) and ``content`` of the record files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return found.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("file"), "content")


def build_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Verify every record and write the offset index: file order, id, offset, length, tokens, checksum, tokens before it in its file."""
    prepare(spark)
    long = T.LongType()
    names = ["record_offset", "record_bytes", "n_tokens", "ids_crc32", "tokens_before"]
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("doc_id", long), *(T.StructField(c, long) for c in names)])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data, at, before, rows = content.as_py(), 0, 0, []
                while at < len(data):
                    doc, ids, after = parse(data, at)
                    rows.append((doc, at, after - at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    before += len(ids)
                    at = after
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), *(pa.array(c, pa.int64()) for c in columns)], names=["file", "doc_id", *names])

    _files(spark, path).mapInArrow(run, schema).write.parquet(index_path)


def _opener(path: str):
    """A Python file system for a path and the path in it, or nothing where there is none for its scheme."""
    try:
        return pa_fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return None


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """``doc_id`` and ``ids`` (array of long) of the records in ``index`` (any rows of the offset index)."""
    prepare(spark)
    wanted = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("record_offset", "record_bytes"))).alias("at"))  # a file's records at most

    def out(got):
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].astype(np.int64) for g in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    def seek(batches):
        system, root = _opener(path)
        for batch in batches:
            for name, at in zip(batch.column(0), batch.column(1)):
                with system.open_input_file(f"{root.rstrip('/')}/{name.as_py()}") as f:
                    for some in at.as_py():
                        f.seek(some["record_offset"])
                        yield out([parse(f.read(some["record_bytes"]))[:2]])

    def scan(batches):
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                for some in at.as_py():
                    yield out([parse(data, some["record_offset"])[:2]])

    if _opener(path):
        return wanted.select("file", "at").mapInArrow(seek, "doc_id long, ids array<long>")
    return _files(spark, path).join(wanted, "file").select("content", "at").mapInArrow(scan, "doc_id long, ids array<long>")


def starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all records before it, in file order (part, then piece).

    File totals are summed in two levels (groups of a thousand parts), so no task sees all files.
    """
    part = F.regexp_extract("file", r"part-(\d+)-", 1).cast("long")
    piece = F.regexp_extract("file", r"piece=(\d+)", 1).cast("long")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("t")).select("file", "t", part.alias("p"), piece.alias("c"), F.expr("0L").alias("z")).withColumn("g", F.expr("p div 1000"))
    inner = Window.partitionBy("g").orderBy("p", "c").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("z").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    coarse = totals.groupBy("g", "z").agg(F.sum("t").alias("gt")).select("g", F.coalesce(F.sum("gt").over(outer), F.lit(0)).alias("g0"))
    base = totals.withColumn("f0", F.coalesce(F.sum("t").over(inner), F.lit(0))).join(coarse, "g").select("file", (F.col("f0") + F.col("g0")).alias("base"))
    return index.join(base, "file").withColumn("start", F.col("base") + F.col("tokens_before"))


def token_records(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write, index and read back: ``doc_id, start, n_tokens, ids_crc32`` per document, from the files.

    See ``write_records`` for nulls, ties, repeated rows, very long texts and empty tables.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "records")
    write_records(docs, f"{root}/data", tokenizer_path, **options)
    build_index(spark, f"{root}/data", f"{root}/index")
    return starts(spark.read.parquet(f"{root}/index")).select("doc_id", "start", "n_tokens", "ids_crc32")

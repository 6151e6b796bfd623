"""A block log derived from the ``events`` table, as the benchmark tables hold none.

The mapping is this library's own: a segment is a day, an error is a trim, everything else a
write; blocks scatter over a small device so that writes overlap. ``version`` orders entries by
(segment, position), as labels and positions do in a real log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions.labels import tai64n
from palimpsest.runtime import prepare, scratch_path
from palimpsest.sources import logformat
from palimpsest.sources.files import system_of

BLOCK_SIZE = 4096
DEVICE_BLOCKS = 20_000
#: Versions are segment * 10**10 + position.
VERSION_BASE = 10_000_000_000


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segment, entry_index, version, op, block, blocks, length, timestamp_ns`` per event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    segment = F.dayofmonth("ts").cast("long")
    blocks = F.lit(1) + F.col("event_id") % 8
    return events.select(
        segment.alias("segment"),
        F.col("event_id").alias("entry_index"),
        (segment * VERSION_BASE + F.col("event_id")).alias("version"),
        F.when(F.col("event_type") == "error", "T").otherwise("W").alias("op"),
        ((F.col("event_id") * 7919 + F.col("user_id") * 31) % DEVICE_BLOCKS).alias("block"),
        blocks.alias("blocks"),
        (blocks * BLOCK_SIZE).alias("length"),
    )


#: The same rows in SQL, as a common table expression.
ENTRIES_SQL = f"""entries AS (
  SELECT CAST(day(ts) AS BIGINT) AS segment, event_id AS entry_index,
         CAST(day(ts) AS BIGINT) * {VERSION_BASE} + event_id AS version,
         CASE WHEN event_type = 'error' THEN 'T' ELSE 'W' END AS op,
         (event_id * 7919 + user_id * 31) % {DEVICE_BLOCKS} AS block,
         1 + event_id % 8 AS blocks, (1 + event_id % 8) * {BLOCK_SIZE} AS length
  FROM events)"""


#: The log of all texts: block size, and entries of a segment.
TEXT_BLOCK, TEXT_SEGMENT = 512, 50


def text_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of whole texts: each document a write of its text, padded to blocks, or (every eleventh) a trim of that length. Blocks overlap."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    n = F.octet_length("text")
    blocks = F.greatest(F.ceil(n / TEXT_BLOCK), F.lit(1)).cast("long")
    write = F.col("doc_id") % 11 != 0
    return docs.select(
        tai64n(F.floor(F.col("doc_id") / TEXT_SEGMENT).cast("long"), F.lit(0)).alias("segment"),
        F.when(write, "W").otherwise("T").alias("op"),
        ((F.col("doc_id") + 1) * 1_000_000_000).alias("timestamp_ns"),
        F.col("doc_id").alias("sequence"),
        (F.col("doc_id") * 13 % 3000).alias("block"),
        (blocks * TEXT_BLOCK).alias("length"),
        F.when(write, F.concat("text", F.unhex(F.repeat(F.lit("00"), (blocks * TEXT_BLOCK - n).cast("int"))))).alias("data"),
        F.lit(None).cast("long").alias("checksum"),
    )


def written_text_log(spark: SparkSession, sf_dir: str) -> str:
    """``text_log`` as segments in a scratch folder; the folder."""
    folder = scratch_path(spark, "log")
    logformat.write_log(text_log(spark, sf_dir), folder, TEXT_BLOCK, 1 << 30)
    return folder


def append_bytes(segments: DataFrame, folder: str, data: bytes) -> None:
    """Append bytes to segment files (``segment, path``), as a writer that crashed may leave them."""
    prepare(segments.sparkSession)

    def run(batches):
        system, _ = system_of(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(path) as f:
                    whole = f.read()
                with system.open_output_stream(path) as f:
                    f.write(whole + data)
            yield batch

    segments.select("path").mapInArrow(run, "path string").count()


#: The entries of ``text_log`` in SQL (version: the document, whose order is that of labels and positions), with their bytes in hexadecimal.
TEXT_LOG_SQL = f"""texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
entries AS (SELECT doc_id AS version, format('{{:016x}}{{:08x}}', doc_id // {TEXT_SEGMENT} + 4611686018427387904, 0) AS segment, doc_id - min(doc_id) OVER (PARTITION BY doc_id // {TEXT_SEGMENT}) AS entry_index,
  CASE WHEN doc_id % 11 <> 0 THEN 'W' ELSE 'T' END AS op, doc_id * 13 % 3000 AS block, CAST(greatest((n + {TEXT_BLOCK - 1}) // {TEXT_BLOCK}, 1) AS BIGINT) AS blocks,
  CAST(greatest((n + {TEXT_BLOCK - 1}) // {TEXT_BLOCK}, 1) * {TEXT_BLOCK} AS BIGINT) AS length, rpad(h, CAST(greatest((n + {TEXT_BLOCK - 1}) // {TEXT_BLOCK}, 1) * {2 * TEXT_BLOCK} AS INTEGER), '0') AS h FROM texts)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot runs from documents: ``run_index, run_bytes, sha256, prev_sha256``; every fifth run is zeros."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    zero = (F.col("doc_id") % 5).isin(0, 1)
    data = F.when(zero, F.lit("0" * 16)).otherwise(F.coalesce("text", F.lit("")))
    sha = F.sha2(data.cast("binary"), 256)
    prev = F.when(F.col("doc_id") % 3 == 0, sha).when(F.col("doc_id") % 7 == 0, F.lit("stale"))
    return docs.select(F.col("doc_id").alias("run_index"), F.length(data.cast("binary")).cast("long").alias("run_bytes"), sha.alias("sha256"), prev.alias("prev_sha256"), (F.lit(15) * F.col("doc_id")).alias("block"))


RUNS_SQL = """runs AS (
  SELECT run_index, run_bytes, sha256, CASE WHEN run_index % 3 = 0 THEN sha256 WHEN run_index % 7 = 0 THEN 'stale' END AS prev_sha256, 15 * run_index AS block
  FROM (SELECT doc_id AS run_index, CAST(strlen(data) AS BIGINT) AS run_bytes, sha256(data) AS sha256
        FROM (SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN repeat('0', 16) ELSE coalesce(text, '') END AS data FROM documents)))"""
ZERO_RUN_SQL = "sha256(repeat('0', 16))"

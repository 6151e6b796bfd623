"""Registered queries of the library's operators and their DuckDB SQL, over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions import checks, labels as L
from palimpsest.functions.checks import crc_valid
from palimpsest.operators import changes, compact, image, intervals, jobs, liveness, overlay, replay
from palimpsest.operators.clusterstore import ClusterStore
from palimpsest.operators.livestore import LiveMap
from palimpsest.operators.numbering import numbered, parts_of
from palimpsest.plans.derived import BLOCK_SIZE, DEVICE_BLOCKS, ENTRIES_SQL, RUNS_SQL, TEXT_LOG_SQL, ZERO_RUN_SQL, append_bytes, entries, runs, written_text_log
from palimpsest.runtime import scratch_path, stored
from palimpsest.sources import imagefile, imagewriter, logformat, payload
from palimpsest.sources.files import system_of
from palimpsest.streaming import misses, plane, rotation, watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Live extents in SQL, for entries named ``entries``.
LIVE_SQL = """each AS (SELECT version, unnest(range(block, block + blocks)) AS blk FROM entries),
top AS (SELECT blk, max(version) AS version FROM each GROUP BY blk),
live AS (SELECT version, min(blk) AS start, CAST(count(*) AS BIGINT) AS blocks
         FROM (SELECT version, blk, blk - row_number() OVER (PARTITION BY version ORDER BY blk) AS run FROM top) GROUP BY version, run),
ext AS (SELECT l.start, l.blocks, l.version, e.segment, e.entry_index, e.op, e.block AS ref_block, e.length FROM live l JOIN entries e USING (version))"""
STATS_SQL = f"""totals AS (SELECT segment, CAST(count(*) AS BIGINT) AS total_entries, CAST(coalesce(sum(length) FILTER (op = 'W'), 0) AS BIGINT) AS total_write_bytes FROM entries GROUP BY segment),
alive AS (SELECT segment, CAST(coalesce(sum(blocks * {BLOCK_SIZE}) FILTER (op = 'W'), 0) AS BIGINT) AS live_write_bytes, CAST(count(*) AS BIGINT) AS live_entries FROM ext GROUP BY segment),
stats AS (SELECT segment, total_entries, total_write_bytes, coalesce(live_write_bytes, 0) AS live_write_bytes, coalesce(live_entries, 0) AS live_entries,
  CASE WHEN total_write_bytes = 0 THEN 1.0::DOUBLE ELSE coalesce(live_write_bytes, 0)::DOUBLE / total_write_bytes::DOUBLE END AS utilization
  FROM totals LEFT JOIN alive USING (segment)),
retired AS (SELECT * FROM stats WHERE utilization < 0.6 AND total_write_bytes > 0 AND (segment < (SELECT max(segment) FROM stats) OR (SELECT count(*) FROM stats) = 1))"""
THRESHOLD = 60.0
#: Islands in SQL, for intervals named ``iv`` (lo, hi).
ISLANDS_SQL = """marked AS (SELECT lo, hi, CASE WHEN lo > max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM iv),
isl AS (SELECT min(lo) AS lo, max(hi) AS hi FROM (SELECT lo, hi, sum(fresh) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY g)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.live_extents(entries(spark, sf_dir))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = entries(spark, sf_dir)
    return liveness.segment_stats(liveness.segment_totals(log), overlay.live_extents(log), BLOCK_SIZE)


EXTENT_COLUMNS = ["start", "blocks", "segment", "entry_index", "op", "ref_block", "length"]
_EXT_SELECT = f"WITH {ENTRIES_SQL}, {LIVE_SQL} SELECT start, blocks, segment, entry_index, op, ref_block, length FROM ext"


@query(_EXT_SELECT)
def overlay_live_extents(spark, sf_dir):
    return _live(spark, sf_dir).select(*EXTENT_COLUMNS)


@query(_EXT_SELECT)
def overlay_live_extents_bucketed(spark, sf_dir):
    """With buckets of two blocks, so that most entries cover some bucket whole."""
    return overlay.live_extents(entries(spark, sf_dir), "buckets", width=2).select(*EXTENT_COLUMNS)


@query(_EXT_SELECT)
def overlay_live_extents_exploded(spark, sf_dir):
    """By single blocks, the plan for narrow entries alone."""
    return overlay.live_extents(entries(spark, sf_dir), "explode").select(*EXTENT_COLUMNS)


@query(_EXT_SELECT + " WHERE op = 'W'")
def extent_map_writes_only(spark, sf_dir):
    return overlay.write_extents(entries(spark, sf_dir)).select(*EXTENT_COLUMNS)


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL} SELECT CAST(count(*) AS BIGINT) AS extents FROM ext WHERE op = 'W'")
def extent_count(spark, sf_dir):
    return overlay.write_extents(entries(spark, sf_dir)).agg(F.count(F.lit(1)).alias("extents"))


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL}, {STATS_SQL} SELECT * FROM totals")
def segment_totals(spark, sf_dir):
    return liveness.segment_totals(entries(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL}, {STATS_SQL} SELECT * FROM stats")
def segment_utilization(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL}, {STATS_SQL} SELECT * FROM retired")
def retire_candidates(spark, sf_dir):
    return liveness.retire_candidates(_stats(spark, sf_dir), THRESHOLD)


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL}, {STATS_SQL} SELECT CAST(count(*) AS BIGINT) AS segments, CAST(coalesce(sum(total_write_bytes - live_write_bytes), 0) AS BIGINT) AS reclaimable_bytes FROM retired")
def reclaimable_bytes(spark, sf_dir):
    return liveness.reclaimable(_stats(spark, sf_dir), THRESHOLD)


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL} SELECT start, blocks, segment, op FROM ext WHERE segment <> 3")
def removed_segment(spark, sf_dir):
    return overlay.remove_segment(_live(spark, sf_dir), 3).select("start", "blocks", "segment", "op")


@query(f"""WITH {ENTRIES_SQL}, {LIVE_SQL}, own AS (SELECT CASE WHEN segment = 3 THEN 4 ELSE segment END AS segment, op, start, blocks FROM ext),
m AS (SELECT *, CASE WHEN start = lag(start + blocks) OVER (PARTITION BY segment, op ORDER BY start) THEN 0 ELSE 1 END AS fresh FROM own),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY segment, op ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT CAST(segment AS BIGINT) AS segment, op, min(start) AS start, CAST(sum(blocks) AS BIGINT) AS blocks FROM r GROUP BY segment, op, g""")
def reattributed_segment(spark, sf_dir):
    return overlay.reattribute_segment(_live(spark, sf_dir), 3, 4).select(F.col("segment").cast("long").alias("segment"), "op", "start", "blocks")


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL} SELECT start, blocks, segment, op FROM ext WHERE segment = 5")
def segment_live_extents(spark, sf_dir):
    return _live(spark, sf_dir).where("segment = 5").select("start", "blocks", "segment", "op")


@query(_EXT_SELECT.replace("start, blocks, segment, entry_index, op, ref_block, length FROM ext", "start, blocks, segment, op FROM ext"))
def incremental_live_extents(spark, sf_dir):
    """The first ten days folded into a state, then the rest: equals one fold of all."""
    log = entries(spark, sf_dir)
    first = overlay.live_extents(log.where("segment <= 10")).select("version", "segment", "op", "start", "blocks")
    return overlay.apply(first, replay.since(log, 10)).select("start", "blocks", "segment", "op")


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL} SELECT DISTINCT segment FROM ext WHERE segment % 4 <> 0")
def orphan_segments(spark, sf_dir):
    log = entries(spark, sf_dir)
    return liveness.orphans(_live(spark, sf_dir), log.where("segment % 4 = 0").select("segment").distinct())


# ---- intervals

_WRITES_IV = "iv AS (SELECT block AS lo, block + blocks AS hi FROM entries WHERE op = 'W')"


def _writes(spark, sf_dir) -> DataFrame:
    return entries(spark, sf_dir).where("op = 'W'").select(F.col("block").alias("lo"), (F.col("block") + F.col("blocks")).alias("hi"))


@query(f"WITH {ENTRIES_SQL}, {_WRITES_IV}, {ISLANDS_SQL} SELECT lo, hi FROM isl")
def coalesced_write_intervals(spark, sf_dir):
    return intervals.coalesce(_writes(spark, sf_dir), span=DEVICE_BLOCKS)


@query(f"""WITH {ENTRIES_SQL}, {_WRITES_IV}, {ISLANDS_SQL}, e AS (SELECT lo, hi FROM isl UNION ALL SELECT {DEVICE_BLOCKS}, {DEVICE_BLOCKS}),
g AS (SELECT coalesce(lag(hi) OVER (ORDER BY lo), 0) AS lo, lo AS hi FROM e) SELECT CAST(lo AS BIGINT) AS lo, CAST(least(hi, {DEVICE_BLOCKS}) AS BIGINT) AS hi FROM g WHERE lo < hi""")
def uncovered_gaps(spark, sf_dir):
    return intervals.gaps(_writes(spark, sf_dir), 0, DEVICE_BLOCKS)


_ASK = "asked AS (SELECT CAST(doc_id AS BIGINT) AS q_id, CAST((doc_id * 37) % 19000 AS BIGINT) AS q_lo, CAST((doc_id * 37) % 19000 + 1 + doc_id % 40 AS BIGINT) AS q_hi FROM documents)"


def _asked(spark, sf_dir) -> DataFrame:
    lo = (F.col("doc_id") * 37) % 19000
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("q_id"), lo.alias("q_lo"), (lo + 1 + F.col("doc_id") % 40).alias("q_hi"))


@query(f"WITH {ENTRIES_SQL}, {_WRITES_IV}, {ISLANDS_SQL}, {_ASK} SELECT q_id, q_lo, q_hi, EXISTS (SELECT 1 FROM isl WHERE lo <= q_lo AND hi >= q_hi) AS covered FROM asked")
def covers_all(spark, sf_dir):
    return intervals.covers(_writes(spark, sf_dir), _asked(spark, sf_dir), span=DEVICE_BLOCKS)


@query(f"""WITH {ENTRIES_SQL}, {LIVE_SQL}, {_ASK} SELECT q_id, greatest(start, q_lo) AS start, least(start + blocks, q_hi) - greatest(start, q_lo) AS blocks, segment, entry_index
FROM asked JOIN (SELECT * FROM ext WHERE op = 'W') x ON start < q_hi AND start + blocks > q_lo""")
def extent_lookup_clipped(spark, sf_dir):
    return intervals.lookup(overlay.write_extents(entries(spark, sf_dir)), _asked(spark, sf_dir)).select("q_id", "start", "blocks", "segment", "entry_index")


@query(f"""WITH {ENTRIES_SQL}, {LIVE_SQL}, missed AS (SELECT DISTINCT CAST(doc_id % 1250 AS BIGINT) AS cluster FROM documents)
SELECT cluster, CAST(sum(least(start + blocks, cluster * 16 + 16) - greatest(start, cluster * 16)) AS BIGINT) AS blocks, CAST(count(*) AS BIGINT) AS parts
FROM missed JOIN (SELECT * FROM ext WHERE op = 'W') x ON start < cluster * 16 + 16 AND start + blocks > cluster * 16 GROUP BY cluster""")
def cluster_miss_resolution(spark, sf_dir):
    """Blocks of the log that fill each missed 64 KiB cluster."""
    missed = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 1250).alias("cluster")).distinct()
    asked = missed.select("cluster", (F.col("cluster") * 16).alias("q_lo"), (F.col("cluster") * 16 + 16).alias("q_hi"))
    met = intervals.lookup(overlay.write_extents(entries(spark, sf_dir)), asked)
    return met.groupBy("cluster").agg(F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("parts"))


# ---- compaction and replay

@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL} SELECT segment, entry_index, op, start AS block, blocks * {BLOCK_SIZE} AS length FROM ext")
def repacked_entries(spark, sf_dir):
    return compact.repack(entries(spark, sf_dir), BLOCK_SIZE).select("segment", "entry_index", "op", F.col("start").alias("block"), "length")


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL} SELECT segment, entry_index, op, start AS block, blocks * {BLOCK_SIZE} AS length FROM ext WHERE segment IN (2, 3, 5)")
def retired_entries(spark, sf_dir):
    log = entries(spark, sf_dir)
    return compact.retire(log, overlay.live_extents(log), [2, 3, 5], BLOCK_SIZE).select("segment", "entry_index", "op", F.col("start").alias("block"), "length")


@query(f"""WITH {ENTRIES_SQL}, each AS (SELECT segment, version, unnest(range(block, block + blocks)) AS blk FROM entries), top AS (SELECT segment, blk, max(version) AS version FROM each GROUP BY ALL)
SELECT segment, CAST(count(*) AS BIGINT) AS own_blocks, CAST(count(DISTINCT version) AS BIGINT) AS own_entries FROM top GROUP BY segment""")
def shadow_within_segment(spark, sf_dir):
    own = compact.live_extents_per_segment(entries(spark, sf_dir))
    return own.groupBy("segment").agg(F.sum("blocks").alias("own_blocks"), F.countDistinct("version").alias("own_entries"))


@query(f"WITH {ENTRIES_SQL}, {LIVE_SQL} SELECT t.blk, e.segment, e.op, e.entry_index FROM top t JOIN entries e USING (version)")
def replay_latest_block_owner(spark, sf_dir):
    log = entries(spark, sf_dir)
    return replay.block_owners(log).join(log.select("version", "entry_index"), "version").select("blk", "segment", "op", "entry_index")


@query(f"""WITH {ENTRIES_SQL}, e AS (SELECT * FROM entries WHERE segment > 10) SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (op = 'W') AS BIGINT) AS writes, CAST(count(*) FILTER (op = 'T') AS BIGINT) AS trims,
CAST(coalesce(sum(length) FILTER (op = 'W'), 0) AS BIGINT) AS write_bytes, CAST(coalesce(sum(length) FILTER (op = 'T'), 0) AS BIGINT) AS trim_bytes, CAST(0 AS BIGINT) AS crc_errors FROM e""")
def incremental_replay_counters(spark, sf_dir):
    return liveness.replay_counters(replay.since(entries(spark, sf_dir), 10))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents) SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (doc_id % 11 <> 0) AS BIGINT) AS writes, CAST(count(*) FILTER (doc_id % 11 = 0) AS BIGINT) AS trims,
CAST(coalesce(sum(n) FILTER (doc_id % 11 <> 0), 0) AS BIGINT) AS write_bytes, CAST(coalesce(sum(n) FILTER (doc_id % 11 = 0), 0) AS BIGINT) AS trim_bytes, CAST(count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 9 = 0) AS BIGINT) AS crc_errors FROM d""")
def checked_replay_counters(spark, sf_dir):
    """A log of all texts, a ninth of them with a wrong checksum: counted, still applied."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", data.alias("data"))
    op = F.when(F.col("doc_id") % 11 == 0, "T").otherwise("W")
    log = docs.select(op.alias("op"), "data", F.octet_length("data").cast("long").alias("length"), (F.crc32("data") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)).alias("checksum"))
    return liveness.replay_counters(log.withColumn("ok", crc_valid(F.col("op"), F.col("data"), F.col("checksum"))), "ok")


@query("SELECT event_id, CAST((event_id * 37 + 4095) // 4096 * 4096 AS BIGINT) AS aligned, CAST(greatest(event_id * 37 // 4096, 1) AS BIGINT) AS blocks, CAST((event_id * 37) % 4096 <> 0 AS BOOLEAN) AS odd FROM events")
def aligned_lengths(spark, sf_dir):
    n = F.col("event_id") * 37
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", L.align_up(n).alias("aligned"), L.block_count(n, BLOCK_SIZE).alias("blocks"), (n % BLOCK_SIZE != 0).alias("odd"))


@query("SELECT doc_id, starts_with(substr('4C42444351573200', 1, CAST(2 * (doc_id % 10) AS BIGINT)) || hex(encode(coalesce(text, ''))), '4C42444351573200') AS image FROM documents")
def magic_sniff(spark, sf_dir):
    """Which contents begin as an image file does: texts behind none, some or all of the magic bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.substring(F.unhex(F.lit("4C42444351573200")), 1, (F.col("doc_id") % 10).cast("int"))
    return docs.select("doc_id", checks.is_magic(F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("image"))


@query(f"""WITH {ENTRIES_SQL}, w AS (SELECT block * {BLOCK_SIZE} AS lo, (block + blocks) * {BLOCK_SIZE} AS hi FROM entries WHERE op = 'W'), iv AS (SELECT * FROM w), {ISLANDS_SQL},
r AS (SELECT DISTINCT CAST(doc_id * 61440 AS BIGINT) AS lo, CAST(doc_id * 61440 + 61440 AS BIGINT) AS hi FROM documents) SELECT r.lo, r.hi FROM r WHERE EXISTS (SELECT 1 FROM isl WHERE isl.lo <= r.lo AND isl.hi >= r.hi)""")
def runs_in_holes(spark, sf_dir):
    """Runs of a device that one range of a map contains whole (here: the ranges that were ever written)."""
    log = entries(spark, sf_dir).where("op = 'W'")
    ranges = log.select((F.col("block") * BLOCK_SIZE).alias("lo"), ((F.col("block") + F.col("blocks")) * BLOCK_SIZE).alias("hi"))
    asked = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") * 61440).alias("lo"), (F.col("doc_id") * 61440 + 61440).alias("hi")).distinct()
    return changes.in_hole(asked, ranges)


@query(f"WITH {ENTRIES_SQL}, f AS (SELECT segment AS name, CAST(sum(length) AS BIGINT) AS bytes FROM entries GROUP BY segment), r AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older, (SELECT sum(bytes) FROM f) AS total FROM f) SELECT name, bytes FROM r WHERE total - older > 50000000")
def log_limit_victims(spark, sf_dir):
    files = entries(spark, sf_dir).groupBy(F.col("segment").alias("name")).agg(F.sum("length").alias("bytes"))
    return liveness.limit_victims(files, 50_000_000)


@query("SELECT doc_id, sha256(unhex(substr(hex(encode(text)), CAST(32 * (1 + doc_id % 7) + 1 AS BIGINT), CAST(32 * (1 + doc_id % 5) AS BIGINT)))) AS part_sha256 FROM documents")
def payload_slice(spark, sf_dir):
    """Some blocks of the UTF-8 bytes of every text, from a place of its own."""
    part = compact.slice_payload(F.encode("text", "UTF-8"), 3 + F.col("doc_id") % 7, F.lit(2), 1 + F.col("doc_id") % 5, 16)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(part, 256).alias("part_sha256"))


@query("SELECT doc_id, sha256(unhex(substr(hex(encode(text)), 33, 128))) AS part_sha256 FROM documents")
def payload_slice_bytes(spark, sf_dir):
    """Two blocks of the UTF-8 bytes of every text: null stays null, a short text gives a shorter slice."""
    part = compact.slice_payload(F.encode("text", "UTF-8"), F.lit(3), F.lit(2), F.lit(4), 16)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(part, 256).alias("part_sha256"))


@query()
def payload_crc32(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    made = docs.withColumn("checksum", F.crc32("data"))
    return made.select("doc_id", "checksum", crc_valid(F.lit("W"), F.col("data"), F.col("checksum")).alias("valid"))


# ---- change detection

_CLASSIFIED = f"{RUNS_SQL}, c AS (SELECT *, sha256 = {ZERO_RUN_SQL} AS is_zero, prev_sha256 IS NULL OR prev_sha256 <> sha256 AS changed FROM runs)"
_TRIMS = """z AS (SELECT *, sum(CASE WHEN is_zero THEN 0 ELSE 1 END) OVER (ORDER BY run_index) AS g FROM c),
s AS (SELECT g, min(run_index) FILTER (changed) AS start_run FROM z WHERE is_zero GROUP BY g),
t AS (SELECT start_run, CAST(count(*) AS BIGINT) AS runs, CAST(sum(run_bytes) AS BIGINT) AS bytes FROM z JOIN s USING (g) WHERE is_zero AND run_index >= start_run GROUP BY start_run)"""


def _classified(spark, sf_dir) -> DataFrame:
    return changes.classify(runs(spark, sf_dir), F.sha2(F.lit("0" * 16).cast("binary"), 256))


@query(f"WITH {_CLASSIFIED} SELECT run_index, block, run_bytes, sha256 FROM c WHERE changed AND NOT is_zero")
def changed_runs_sha256(spark, sf_dir):
    return changes.changed_writes(_classified(spark, sf_dir)).select("run_index", "block", "run_bytes", "sha256")


@query(f"WITH {_CLASSIFIED}, {_TRIMS} SELECT * FROM t")
def trim_islands(spark, sf_dir):
    return changes.trim_islands(_classified(spark, sf_dir))


@query(f"WITH {_CLASSIFIED}, {_TRIMS} SELECT CAST(count(*) AS BIGINT) AS total_runs, CAST(count(*) FILTER (changed AND NOT is_zero) AS BIGINT) AS writes, CAST(coalesce(sum(run_bytes) FILTER (changed AND NOT is_zero), 0) AS BIGINT) AS write_bytes, (SELECT count(*) FROM t) AS trims FROM c")
def scan_counters(spark, sf_dir):
    return changes.scan_counters(_classified(spark, sf_dir))


# ---- images

_CLUSTERS = "prim AS (SELECT doc_id AS cluster, CASE WHEN doc_id % 6 <> 0 THEN sha256(coalesce(text, '')) END AS data FROM documents WHERE doc_id % 2 = 0), base AS (SELECT doc_id AS cluster, sha256(coalesce(lang, '')) AS data FROM documents)"


@query(f"""WITH {_CLUSTERS} SELECT cluster, CASE WHEN p.cluster IS NOT NULL AND p.data IS NOT NULL THEN 'primary' WHEN p.cluster IS NOT NULL THEN 'trimmed' ELSE 'base' END AS source,
sha256(CASE WHEN p.cluster IS NOT NULL THEN coalesce(p.data, repeat(chr(0), 4)) ELSE b.data END) AS data_sha256 FROM prim p FULL JOIN base b USING (cluster)""")
def layered_cluster_source(spark, sf_dir):
    """A base of all documents under an overlay of some, a few of them trimmed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("cluster"), "text", "lang")
    digest = lambda c: F.encode(F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256), "UTF-8")
    primary = docs.where("cluster % 2 = 0").select("cluster", F.when(F.col("cluster") % 6 != 0, digest(F.col("text"))).alias("data"))
    base = docs.select("cluster", digest(F.col("lang")).alias("data"))
    return image.layered(primary, base, 4).select("cluster", "source", F.sha2("data", 256).alias("data_sha256"))


@query("SELECT doc_id AS cluster, CAST((doc_id * 977) // 8191 AS BIGINT) AS l1, CAST((doc_id * 977) % 8191 AS BIGINT) AS l2 FROM documents")
def image_geometry(spark, sf_dir):
    l1, l2 = image.geometry(F.col("cluster") * 977, 65536)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("cluster")).select("cluster", l1.alias("l1"), l2.alias("l2"))


# ---- rows as text

@query("SELECT event_id, format('{:016x}{:08x}', epoch_us(ts) // 1000000 + 4611686018427387904, CAST(event_id % 1000000000 AS BIGINT)) AS label FROM events")
def segment_label_tai64n(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return events.select("event_id", L.tai64n(seconds, F.col("event_id") % 1_000_000_000).alias("label"))


@query(f"""WITH {ENTRIES_SQL} SELECT segment, entry_index, CASE op WHEN 'W' THEN 'WRITE' WHEN 'T' THEN 'TRIM' ELSE 'UNKNOWN(' || op || ')' END AS kind, block, block + length // {BLOCK_SIZE} - 1 AS block_end,
length // {BLOCK_SIZE} AS n_blocks, block * {BLOCK_SIZE} AS offset_start, block * {BLOCK_SIZE} + length - 1 AS offset_end, printf('%.1f KiB', length / 1024.0) AS size FROM entries""")
def show_entries(spark, sf_dir):
    from palimpsest.operators.show import described

    return described(entries(spark, sf_dir), BLOCK_SIZE).select("segment", "entry_index", "kind", "block", "block_end", "n_blocks", "offset_start", "offset_end", "size")


@query("""SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE n || ' B' END AS size
FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS BIGINT) AS n FROM orders)""")
def formatted_sizes(spark, sf_dir):
    n = (F.col("o_orderkey") * F.col("o_orderkey")).cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", L.format_size(n).alias("size"))


@query("SELECT o_orderkey, CAST(o_orderkey * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS BIGINT) AS bytes FROM orders")
def parsed_sizes(spark, sf_dir):
    suffix = F.element_at(F.array(F.lit(""), F.lit("k"), F.lit(" MB"), F.lit("G")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.col("o_orderkey").cast("string"), suffix)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", L.parse_size(text).alias("bytes"))


@query(f"""WITH {ENTRIES_SQL}, b AS (SELECT *, CAST(coalesce(sum(CASE WHEN op = 'W' THEN length ELSE 0 END) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, row_number() OVER (ORDER BY version) - 1 AS i FROM entries)
SELECT before // 1048576 AS part, CAST(count(*) AS BIGINT) AS entries, CAST(sum(CASE WHEN op = 'W' THEN length ELSE 0 END) AS BIGINT) AS bytes, min(i) AS first_sequence, max(segment) AS last_day FROM b GROUP BY 1""")
def rotation_by_size(spark, sf_dir):
    """The whole log dealt to segments of 1 MiB of payload, in order, numbered by day without a global sort."""
    size = F.when(F.col("op") == "W", F.col("length")).otherwise(0)
    parts = parts_of(numbered(entries(spark, sf_dir), ["segment"], ["version"], size), 1 << 20)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("entries"), F.sum(size).cast("long").alias("bytes"), F.min("sequence").alias("first_sequence"), F.max("segment").alias("last_day"))


# ---- codecs, checksums, jobs: round trips and probes over whole tables

@query("SELECT doc_id, sha256(coalesce(text, '')) AS data_sha256, TRUE AS same FROM documents")
def lz4_round_trip(spark, sf_dir):
    """Every text packed and unpacked again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    back = docs.withColumn("back", checks.lz4_decompress(checks.lz4_compress("data"), F.octet_length("data")))
    return back.select("doc_id", F.sha2("back", 256).alias("data_sha256"), (F.col("back") == F.col("data")).alias("same"))


@query()
def payload_crc32c(spark, sf_dir):
    """CRC-32C of every text; held against a plain computation in the tests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return docs.select("doc_id", checks.crc32c_col("data").alias("checksum"))


@query(f"""WITH {RUNS_SQL}, saved AS (SELECT run_index, CASE WHEN run_index % 3 = 0 THEN sha256 ELSE 'stale' END AS old FROM runs WHERE run_index % 3 = 0 OR run_index % 7 = 0)
SELECT run_index, sha256 = {ZERO_RUN_SQL} AS is_zero, old IS NULL OR old <> sha256 AS changed FROM runs LEFT JOIN saved USING (run_index)""")
def run_hash_probe(spark, sf_dir):
    """Runs against a saved state of hashes, by a join."""
    now = runs(spark, sf_dir).drop("prev_sha256")
    at = F.col("run_index")
    saved = now.where((at % 3 == 0) | (at % 7 == 0)).select(at, F.when(at % 3 == 0, F.col("sha256")).otherwise("stale").alias("sha256"))
    return changes.probe(now, saved, F.sha2(F.lit("0" * 16).cast("binary"), 256)).select("run_index", "is_zero", "changed")


@query(f"""WITH {ENTRIES_SQL}, {LIVE_SQL}, {STATS_SQL} SELECT s.segment, s.segment IN (SELECT segment FROM retired) AS retired,
  CASE WHEN s.segment IN (SELECT segment FROM retired) THEN live_entries ELSE 0 END AS copied_entries, CASE WHEN s.segment IN (SELECT segment FROM retired) THEN live_write_bytes ELSE 0 END AS copied_bytes FROM stats s""")
def gc_outcome(spark, sf_dir):
    """What a collection of the log does with each segment."""
    log = entries(spark, sf_dir)
    live = stored(overlay.live_extents(log).select("segment", "op", "start", "blocks"), "live")  # the overlay once, for both uses
    stats = stored(liveness.segment_stats(liveness.segment_totals(log), live, BLOCK_SIZE), "stats")
    gone = liveness.retire_candidates(stats, THRESHOLD).select("segment")
    copied = live.join(gone, "segment", "left_semi").groupBy("segment").agg(F.count(F.lit(1)).alias("copied_entries"), F.sum(F.when(F.col("op") == "W", F.col("blocks") * BLOCK_SIZE)).alias("copied_bytes"))
    rows = stats.select("segment").join(gone.withColumn("retired", F.lit(True)), "segment", "left").join(copied, "segment", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("segment", F.coalesce("retired", F.lit(False)).alias("retired"), zero("copied_entries"), zero("copied_bytes"))


@query("SELECT o_orderkey, CAST(o_orderkey * CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1 ELSE 1024 END AS BIGINT) AS bytes FROM orders")
def parsed_sizes_of_the_tool(spark, sf_dir):
    """The command tool's sizes: decimal and hexadecimal, a suffix it knows or passes over."""
    n, kind = F.col("o_orderkey"), F.col("o_orderkey") % 5
    text = F.when(kind == 0, n.cast("string")).when(kind == 1, F.concat(n.cast("string"), F.lit("k"))).when(kind == 2, F.concat(F.lit("0x"), F.hex(n), F.lit("M"))).when(kind == 3, F.concat(n.cast("string"), F.lit("junk"))).otherwise(F.concat(n.cast("string"), F.lit("Kib")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", L.parse_size_c(text).alias("bytes"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) % 1000000) * 1000 + event_id % 1000 AS VARCHAR), 9, '0') AS time FROM events")
def utc_times(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return events.select("event_id", L.utc_nanos(ns).alias("time"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || to_json(coalesce(lang, '')) || ',"source":' || to_json(coalesce(source, '')) || ',"text":' || to_json(coalesce(text, '')) || '}') AS json_sha256 FROM documents""")
def entries_as_json(spark, sf_dir):
    """Whole rows as JSON, texts with quotes, backslashes and control characters among them."""
    from palimpsest.operators.show import as_json

    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text("lang"), text("source"), text("text"))
    rows = as_json(docs)
    return rows.select(F.get_json_object("json", "$.doc_id").cast("long").alias("doc_id"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


@query("""WITH p AS (SELECT CAST(doc_id * 40 AS BIGINT) AS lo, CAST(doc_id * 40 + 1 + octet_length(encode(coalesce(text, ''))) % 40 AS BIGINT) AS hi FROM documents)
SELECT lo // 1000 AS cluster, CAST(count(*) AS BIGINT) AS pieces, CAST(sum(hi - lo) AS BIGINT) AS bytes FROM (SELECT greatest(lo, c * 1000) AS lo, least(hi, (c + 1) * 1000) AS hi FROM (SELECT *, unnest(range(lo // 1000, (hi - 1) // 1000 + 1)) AS c FROM p)) GROUP BY 1""")
def pieces_by_cluster(spark, sf_dir):
    """Pieces of an image cut at the clusters that they go to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lo = (F.col("doc_id") * 40).alias("lo")
    pieces = docs.select(lo, (F.col("doc_id") * 40 + 1 + F.octet_length(F.coalesce("text", F.lit(""))) % 40).cast("long").alias("hi"))
    return intervals.cut(pieces, "lo", "hi", 1000).groupBy(F.col("bucket").alias("cluster")).agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("hi") - F.col("lo")).alias("bytes"))


_IMAGE_SQL = """WITH t AS (SELECT *, CAST(coalesce(sum(n + 7) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)),
b AS (SELECT (SELECT max(lo + n + 7) FROM t) // 512 AS clusters),
p AS (SELECT lo, lo + n AS hi, h, TRUE AS own FROM t WHERE n > 0 UNION ALL SELECT lo + n + j, lo + n + j + 1, CASE WHEN lo + n + j < 256 * clusters THEN '61' ELSE '00' END, FALSE FROM t, b, range(7) r(j)),
c AS (SELECT cluster, lo, own, substr(h, CAST(2 * (greatest(lo, cluster * 256) - lo) + 1 AS BIGINT), CAST(2 * (least(hi, cluster * 256 + 256) - greatest(lo, cluster * 256)) AS BIGINT)) AS h FROM (SELECT *, unnest(range(lo // 256, (hi - 1) // 256 + 1)) AS cluster FROM p)),
w AS (SELECT cluster, rpad(string_agg(h, '' ORDER BY lo), 512, '0') AS h FROM c GROUP BY cluster HAVING bool_or(own) OR cluster < (SELECT clusters FROM b))"""


def _written_image(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    sized = docs.withColumn("length", F.octet_length("data").cast("long")).withColumn("cell", F.floor(F.col("doc_id") / 1000).cast("long"))
    end = sized.agg(F.coalesce(F.sum(F.col("length") + 7), F.lit(0)).alias("n")).first()["n"]
    parts = image.parts_for(end)
    placed = stored(numbered(sized.repartition(parts, "cell"), ["cell"], ["doc_id"], F.col("length") + 7).withColumnRenamed("before", "offset"), "placed")
    base = spark.range(0, end // 512).select(F.col("id").alias("cluster"), F.unhex(F.repeat(F.lit("61"), 256)).alias("data"))
    return image.from_pieces(placed.where("length > 0").select("offset", "length", "data"), base, 256, parts=parts)


@query(_IMAGE_SQL + " SELECT cluster, CASE WHEN h <> repeat('0', 512) THEN sha256(unhex(h)) END AS data_sha256 FROM w")
def image_writes(spark, sf_dir):
    """Every whole text, seven bytes apart, laid over a base image of 256-byte clusters that reaches half as far."""
    return _written_image(spark, sf_dir).select("cluster", F.sha2("data", 256).alias("data_sha256"))


@query(_IMAGE_SQL + """, f AS (SELECT cluster // 16 AS cluster, string_agg(h, '' ORDER BY part) AS h FROM (SELECT c.cluster * 16 + part AS cluster, part, coalesce(h, repeat('0', 512)) AS h FROM (SELECT DISTINCT cluster // 16 AS cluster FROM w) c CROSS JOIN range(16) r(part) LEFT JOIN w ON w.cluster = c.cluster * 16 + part) GROUP BY 1)
SELECT cluster, sha256(unhex(h)) AS data_sha256 FROM f WHERE h <> repeat('0', 8192)""")
def image_file_clusters(spark, sf_dir):
    """The image of all texts written as an image file of 4 KiB clusters by many tasks, and read back."""
    small = stored(_written_image(spark, sf_dir).where("data is not null"), "small")
    whole = image.from_pieces(image.to_pieces(small, 256), spark.createDataFrame([], "cluster long, data binary"), 4096, parts=image.parts_for(small.count() * 256))
    whole = stored(whole, "clusters")
    size = (whole.agg(F.coalesce(F.max("cluster"), F.lit(0)).alias("n")).first()["n"] + 1) * 4096
    folder = scratch_path(spark, "image")
    system, root = system_of(folder)
    system.create_dir(root, recursive=True)
    imagewriter.write_clusters(whole, f"{root}/disk.img", size, 12)
    return imagefile.read_image(spark, f"{root}/disk.img").select("cluster", F.sha2("data", 256).alias("data_sha256"))


_ROTATION_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id % 50 AS dev_index, event_id AS sequence, epoch_us(ts) * 1000 AS ns, (1 + event_id % 8) * 4096 AS size, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i FROM events),
r AS (SELECT dev_index, i, sequence, size, CAST(0 AS BIGINT) AS part, CAST(CASE WHEN size >= {size} THEN 1 ELSE 0 END AS BIGINT) AS next, CASE WHEN size >= {size} THEN 0 ELSE size END AS held, ns AS began FROM e WHERE i = 1
  UNION ALL SELECT dev_index, i, sequence, size, p, p + CASE WHEN h >= {size} THEN 1 ELSE 0 END, CASE WHEN h >= {size} THEN 0 ELSE h END, CASE WHEN h >= {size} THEN ns ELSE b END
  FROM (SELECT e.*, next + CASE WHEN held > 0 AND e.ns - began >= {age} THEN 1 ELSE 0 END AS p, CASE WHEN held > 0 AND e.ns - began >= {age} THEN 0 ELSE held END + e.size AS h, CASE WHEN held > 0 AND e.ns - began >= {age} THEN e.ns ELSE began END AS b
        FROM r JOIN e ON e.dev_index = r.dev_index AND e.i = r.i + 1))
SELECT dev_index, part, CAST(count(*) AS BIGINT) AS entries, CAST(sum(size) AS BIGINT) AS bytes, min(sequence) AS first_sequence FROM r GROUP BY dev_index, part""".format(size=1 << 20, age=3600 * 10**9)


@query(_ROTATION_SQL)
def rotated_segments(spark, sf_dir):
    """The log of each of fifty devices dealt to segments, by size and age."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = ((1 + F.col("event_id") % 8) * BLOCK_SIZE).alias("bytes")
    log = events.select((F.col("user_id") % 50).alias("dev_index"), F.col("event_id").alias("sequence"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"), size)
    return plane.rotate(log, 1 << 20, 3600).groupBy("dev_index", "part").agg(F.count(F.lit(1)).alias("entries"), F.sum("bytes").alias("bytes"), F.min("sequence").alias("first_sequence"))


# ---- segments written and read as a Spark format

_BYTES_SQL = "CASE WHEN op = 'W' THEN sha256(unhex(h)) END AS data_sha256"
_PART_SQL = "CASE WHEN op = 'W' THEN sha256(unhex(substr(h, CAST((start - block) * 1024 + 1 AS BIGINT), CAST(l.blocks * 1024 AS BIGINT)))) END AS data_sha256"


@query(f"WITH {TEXT_LOG_SQL} SELECT segment, entry_index, op, version AS sequence, block, length, (version + 1) * 1000000000 AS timestamp_ns, {_BYTES_SQL} FROM entries")
def log_source_entries(spark, sf_dir):
    """Every text written as a log entry in the format ``blocklog`` and read back."""
    log = logformat.read(spark, written_text_log(spark, sf_dir))
    return log.select("segment", "entry_index", "op", "sequence", "block", "length", "timestamp_ns", F.sha2("data", 256).alias("data_sha256"))


@query(f"WITH {TEXT_LOG_SQL} SELECT segment, CAST(count(*) AS BIGINT) AS entries, CAST(sum(length) FILTER (op = 'W') AS BIGINT) AS write_bytes, doc_id // 50 % 3 = 0 AS damaged FROM (SELECT *, version AS doc_id FROM entries) GROUP BY segment, doc_id // 50 % 3 = 0")
def log_source_damaged(spark, sf_dir):
    """A third of the segments end in bytes that are no entry: their entries and their error come in one pass."""
    folder = written_text_log(spark, sf_dir)
    odd = spark.createDataFrame([(label, path) for label, path, _ in logformat.list_segment_files(folder)], "segment string, path string").where((L.tai64n_seconds(F.col("segment")) % 3) == 0)
    append_bytes(odd, folder, b"\xa1\x01\x7f")
    rows = logformat.read(spark, folder, ["segment", "op", "length", "error"], mode="PERMISSIVE")
    return rows.groupBy("segment").agg(F.count("op").alias("entries"), F.sum(F.when(F.col("op") == "W", F.col("length"))).alias("write_bytes"), (F.count("error") == 1).alias("damaged"))


@query(f"WITH {TEXT_LOG_SQL}, {LIVE_SQL} SELECT l.start, l.blocks, e.segment, e.entry_index, op, {_PART_SQL} FROM live l JOIN entries e USING (version)")
def late_payload_ranges(spark, sf_dir):
    """What is alive of the log of all texts, its bytes read late, by their places in the segments."""
    folder = written_text_log(spark, sf_dir)
    near = payload.live_ranges(payload.index(spark, folder)).repartition("segment").sortWithinPartitions("segment", "entry_index", "start")
    return payload.fetch(near, folder).select("start", "blocks", "segment", "entry_index", "op", F.sha2("data", 256).alias("data_sha256"))


@query(f"""WITH {TEXT_LOG_SQL}, {LIVE_SQL}, l AS (SELECT l.version, l.start, l.blocks, op, block, h, row_number() OVER (ORDER BY l.version, l.start) - 1 AS sequence,
  CAST(coalesce(sum(CASE WHEN op = 'W' THEN l.blocks * 512 ELSE 0 END) OVER (ORDER BY l.version, l.start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM live l JOIN entries e USING (version))
SELECT CAST(dense_rank() OVER (ORDER BY before // 65536) - 1 AS BIGINT) AS part, sequence, op, start AS block, l.blocks * 512 AS length, (version + 1) * 1000000000 AS timestamp_ns, {_PART_SQL} FROM l""")
def repacked_segments(spark, sf_dir):
    """The log of all texts repacked into segments of at most 128 KiB of payload, numbered over all of them, and read back."""
    folder, out = written_text_log(spark, sf_dir), scratch_path(spark, "packed")
    first = "40000000f0000000" + "0" * 8
    jobs.repack(spark, folder, out, first, segment_bytes=1 << 17)
    part = F.conv(F.substring("segment", 17, 8), 16, 10).cast("long")
    return logformat.read(spark, out).select(part.alias("part"), "sequence", "op", "block", "length", "timestamp_ns", F.sha2("data", 256).alias("data_sha256"))


@query(f"WITH {TEXT_LOG_SQL}, {LIVE_SQL} SELECT start, blocks, segment, entry_index, op FROM ext")
def live_map_in_zones(spark, sf_dir):
    """The log of all texts folded into a stored live map in three turns, the newest segments first."""
    folder = written_text_log(spark, sf_dir)
    live = LiveMap(spark, scratch_path(spark, "zones"), zone_blocks=256)
    labels = [label for label, _, _ in logformat.list_segment_files(folder)]
    for i in (2, 1, 0):
        live.fold(payload.index(spark, folder, segments=labels[len(labels) * i // 3 : len(labels) * (i + 1) // 3]), labels[-1])
    return live.extents().select("start", "blocks", "segment", F.col("version.entry_index").alias("entry_index"), "op")


@query(f"""WITH RECURSIVE {TEXT_LOG_SQL}, e AS MATERIALIZED (SELECT version AS sequence, (version + 1) * 1000000000 AS ns, CASE WHEN op = 'W' THEN length ELSE 0 END AS size, row_number() OVER (ORDER BY version) AS i FROM entries),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS ns, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS part, FALSE AS aged, FALSE AS filled, CAST(0 AS BIGINT) AS next, FALSE AS open, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS began
  UNION ALL SELECT i, sequence, ns, size, p, aged, h + size >= 65536, p + CASE WHEN h + size >= 65536 THEN 1 ELSE 0 END, h + size < 65536, h + size, b FROM (
    SELECT e.*, r.open AND e.ns - r.began >= 40000000000 AS aged, r.next + CASE WHEN r.open AND e.ns - r.began >= 40000000000 THEN 1 ELSE 0 END AS p,
      CASE WHEN r.open AND e.ns - r.began < 40000000000 THEN r.held ELSE 0 END AS h, CASE WHEN r.open AND e.ns - r.began < 40000000000 THEN r.began ELSE e.ns END AS b FROM r JOIN e ON e.i = r.i + 1)),
g AS (SELECT part, CAST(count(*) AS BIGINT) AS entries, CAST(sum(size) AS BIGINT) AS bytes, min(sequence) AS first_sequence, max(sequence) AS last_sequence, bool_or(filled) AS filled FROM r WHERE i > 0 GROUP BY part)
SELECT part, CASE WHEN filled THEN 'size' ELSE 'age' END AS reason, entries, bytes, first_sequence, last_sequence FROM g WHERE filled OR part + 1 IN (SELECT part FROM r WHERE aged)""")
def rotated_stream(spark, sf_dir):
    """The log of all texts watched as a stream and rotated anew by size and age; the closed segments."""
    folder, out = written_text_log(spark, sf_dir), scratch_path(spark, "rotated")
    entries_ = watch.entries(watch.watch(spark, {0: folder}, 1 << 20))
    rows = entries_.select("dev_index", F.lit("entry").alias("kind"), "sequence", "timestamp_ns", F.when(F.col("op") == "W", F.col("length")).otherwise(0).alias("bytes"))
    stream = rotation.rotate_stream(rows, 1 << 16, 40)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "rotated-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rotation.SEGMENTS).parquet(out).select("part", "reason", "entries", "bytes", "first_sequence", "last_sequence")


@query(f"""WITH {TEXT_LOG_SQL}, {LIVE_SQL}, b AS (SELECT t.blk, substr(h, CAST((t.blk - block) * 1024 + 1 AS BIGINT), 1024) AS h FROM top t JOIN entries e USING (version) WHERE op = 'W'),
c AS (SELECT cluster, string_agg(coalesce(b.h, repeat('0', 1024)), '' ORDER BY i) AS h FROM (SELECT DISTINCT blk // 16 AS cluster FROM b), range(16) r(i) LEFT JOIN b ON b.blk = cluster * 16 + i GROUP BY cluster)
SELECT cluster, CASE WHEN h <> repeat('0', 16384) THEN sha256(unhex(h)) END AS data_sha256 FROM c""")
def filled_misses(spark, sf_dir):
    """Every cluster of the device missed once: what the stored live map and the log's payloads fill it with."""
    folder = written_text_log(spark, sf_dir)
    cluster = lambda block: F.floor(block / 16).cast("long")
    asked = payload.index(spark, folder).select(F.explode(F.sequence(cluster(F.col("block")), cluster(F.col("block") + F.col("blocks") - 1))).alias("cluster")).distinct()
    made = misses.filled(spark, asked, folder, ClusterStore(spark, scratch_path(spark, "base")), 16)
    return made.select("cluster", F.sha2("data", 256).alias("data_sha256"))

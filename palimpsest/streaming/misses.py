"""Misses of clusters as a stream: kept tries, lookups in the stored live map, upserts of the base.

A miss of a cluster that the log has blocks of is answered with ``retry`` once the base holds them, three times at most in a row; then, or where the
log knows nothing of it, with ``continue``: it reads zeros. How often a cluster was missed is state of the stream. A batch looks at the
zones of its clusters alone, in the live map and in the base, and reads the payloads that fill them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators import image, jobs
from palimpsest.operators.clusterstore import ClusterStore
from palimpsest.operators.intervals import lookup
from palimpsest.runtime import prepare, stored
from palimpsest.sources import blocklog, payload
from palimpsest.streaming.plane import MAX_RETRIES
from palimpsest.streaming.rotation import use_state_store

#: Seconds after which a cluster's misses are forgotten.
FORGET = 60


class Tries(StatefulProcessor):
    """Numbers the misses of a cluster that follow one another within ``forget`` seconds; after the last try they begin again."""

    def __init__(self, forget: float):
        self.forget_ms = int(forget * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("tries", "tries int, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tries, until = tuple(self.kept.get()) if self.kept.exists() else (0, None)
        if until is not None:
            self.handle.deleteTimer(until)
        for now in sorted(int(r["at"].timestamp() * 1000) for r in rows):
            tries = tries if until is None or now < until else 0
            yield Row(dev_index=key[0], cluster_index=key[1], tries=tries)
            tries, until = tries + 1 if tries < MAX_RETRIES else 0, now + self.forget_ms
        if tries:
            self.kept.update((tries, until))
            self.handle.registerTimer(until)
        else:
            self.kept.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def tried(events: DataFrame, forget: float = FORGET) -> DataFrame:
    """A stream of misses (``dev_index, cluster_index``, and their time ``at``; default: that of their batch) with ``tries``, how often each was answered with a retry before."""
    prepare(events.sparkSession)
    use_state_store(events.sparkSession)
    at = F.col("at") if "at" in events.columns else F.current_timestamp()
    rows = events.select(F.col("dev_index").cast("int").alias("dev_index"), F.col("cluster_index").cast("long").alias("cluster_index"), at.alias("at")).withWatermark("at", f"{int(forget)} seconds")
    return rows.groupBy("dev_index", "cluster_index").transformWithState(statefulProcessor=Tries(forget), outputStructType="dev_index int, cluster_index long, tries int", outputMode="Append", timeMode="EventTime")


def filled(spark: SparkSession, asked: DataFrame, folder: str, base: ClusterStore, cluster_blocks: int) -> DataFrame:
    """``cluster, data`` of the ``asked`` clusters (``cluster``) that the log has blocks of: the base's (or zeros) with those blocks in place."""
    jobs.catch_up(spark, folder, blocklog.list_segments(spark, folder))
    block_size, live = jobs.header_of(spark, folder)["block_size"], jobs.stored_map(spark, folder)
    ranges = asked.select("cluster").distinct().select("cluster", (F.col("cluster") * cluster_blocks).alias("q_lo"), ((F.col("cluster") + 1) * cluster_blocks).alias("q_hi"))
    zone = lambda c: F.floor(c / live.zone_blocks).cast("long")
    zones = [r["z"] for r in ranges.select(F.explode(F.sequence(zone(F.col("q_lo")), zone(F.col("q_hi") - 1))).alias("z")).distinct().collect()]  # of a batch
    met = stored(lookup(live.at(zones).where("op = 'W'"), ranges, width=cluster_blocks).select("cluster", "version", "segment", "op", "start", "blocks"), "met")
    near = payload.located(met, folder).repartition("segment").sortWithinPartitions("segment", "entry_index", "start")
    pieces = stored(payload.fetch(near, folder).select("cluster", (F.col("start") * block_size).alias("offset"), "length", "data"), "pieces")
    under = base.of(pieces.select("cluster"))
    return image.from_pieces(pieces.drop("cluster"), under, cluster_blocks * block_size)


def answered(spark: SparkSession, misses: DataFrame, folder: str, base: ClusterStore, cluster_blocks: int = 16) -> DataFrame:
    """``dev_index, cluster_index, tries, answer`` of a batch of ``misses`` with their ``tries``; the base is published before the answers."""
    due = misses.where(F.col("tries") < MAX_RETRIES)
    made = stored(filled(spark, due.select(F.col("cluster_index").alias("cluster")), folder, base, cluster_blocks), "filled")
    base.upsert(made)
    found = made.select(F.col("cluster").alias("cluster_index"), F.lit(True).alias("found"))
    reply = F.when(F.col("found") & (F.col("tries") < MAX_RETRIES), "retry").otherwise("continue")
    return misses.join(found, "cluster_index", "left").select("dev_index", "cluster_index", "tries", reply.alias("answer"))


def serve(spark: SparkSession, events: DataFrame, folder: str, base_path: str, answers: str, checkpoint: str, cluster_blocks: int = 16, zone_clusters: int | None = None, forget: float = FORGET, **trigger):
    """Answer a stream of misses batch by batch into Parquet at ``answers``. The base may be replaced meanwhile (``ClusterStore.replace``). Returns the running query."""
    base = ClusterStore(spark, base_path, *([] if zone_clusters is None else [zone_clusters]))

    def batch(rows: DataFrame, n: int) -> None:
        misses = stored(rows, "misses")
        answered(spark, misses, folder, base, cluster_blocks).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{answers}/batch={n}")

    return tried(events, forget).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

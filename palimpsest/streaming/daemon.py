"""A disk's running service: its rotations are folded into the live map and uploaded, and its misses are answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators import jobs, upload
from palimpsest.sources import payload
from palimpsest.streaming import misses, watch


def run(
    spark: SparkSession, folder: str, checkpoints: str, store: str | None = None, prefix: str = "", volume: str = "disk", events: DataFrame | None = None, base: str | None = None, answers: str | None = None,
    cluster_blocks: int = 16, segments_per_batch: int = watch.BATCH, **trigger,
) -> list:
    """Start the queries of a disk and return them: one for its rotations and, where ``events`` (a stream of misses), ``base`` and ``answers`` are given, one for its misses.

    What is in the folder already counts as rotated. A batch folds its segments into the folder's live map, then
    uploads what the store's manifest lacks, so a copy that failed is tried again with the next rotation. A batch that is run again changes nothing.
    """
    live = jobs.stored_map(spark, folder)

    def rotated(batch: DataFrame, _: int) -> None:
        labels = sorted(r["label"] for r in batch.select("label").distinct().collect())  # a batch's segments
        if not labels:
            return
        new = payload.index(spark, folder, segments=labels, mode="PERMISSIVE")
        jobs.keep_totals(spark, folder, new)
        live.fold(new, labels[-1])
        if store is not None:
            for r in upload.upload(spark, folder, store, prefix, volume).where(F.col("error").isNotNull()).collect():
                print(f"upload failed for {r['label']}: {r['error']}")

    source = watch.watch(spark, {0: folder}, segments_per_batch)
    queries = [source.writeStream.foreachBatch(rotated).option("checkpointLocation", f"{checkpoints}/rotations").trigger(**(trigger or {"processingTime": "1 second"})).start()]
    if events is not None:
        queries.append(misses.serve(spark, events, folder, base, answers, f"{checkpoints}/misses", cluster_blocks, **(trigger or {"processingTime": "1 second"})))
    return queries

"""Change detection between snapshots by run hashes, with trims for stretches of zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.operators.intervals import levels_of

RUN_BLOCKS, BLOCK_SIZE = 15, 4096
RUN_BYTES = RUN_BLOCKS * BLOCK_SIZE
#: A trim's length at most: the largest block multiple in 32 bits.
MAX_TRIM = (1 << 32) - BLOCK_SIZE


def classify(runs: DataFrame, zero_hash) -> DataFrame:
    """``runs`` (``run_index, sha256, prev_sha256``) with ``is_zero`` and ``changed`` (no or another previous hash)."""
    return runs.withColumn("is_zero", F.col("sha256") == zero_hash).withColumn("changed", F.col("prev_sha256").isNull() | (F.col("prev_sha256") != F.col("sha256")))


def probe(runs: DataFrame, state: DataFrame, zero_hash) -> DataFrame:
    """``runs`` (``run_index, sha256``) classified against a saved state of ``run_index, sha256``, by a join."""
    return classify(runs.join(state.select("run_index", F.col("sha256").alias("prev_sha256")), "run_index", "left"), zero_hash)


def changed_writes(classified: DataFrame) -> DataFrame:
    return classified.where("changed and not is_zero")


def trim_islands(classified: DataFrame, width: int = 4096, span: int | None = None) -> DataFrame:
    """Each stretch of zero runs that holds a changed one, from its first changed run to its end: ``start_run, runs, bytes``.

    Zero runs are first added up within buckets of the device, as pieces of stretches: each with its
    first changed run and the sums from there and of all. Pieces that touch across bucket edges are
    then joined level by level, so a stretch as long as the device is a few thousand rows at each
    level, and no run is read twice. ``span``: the device's runs where known, which saves levels.
    """
    order = Window.partitionBy("bucket").orderBy("run_index")
    zeros = classified.where("is_zero").select("run_index", "run_bytes", "changed", F.floor(F.col("run_index") / width).cast("long").alias("bucket"))
    fresh = zeros.withColumn("new", F.when(F.col("run_index") == F.lag("run_index").over(order) + 1, 0).otherwise(1))
    marked = fresh.withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    within = Window.partitionBy("bucket", "piece").orderBy("run_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("open", F.max("changed").over(within))
    rows = marked.groupBy("bucket", "piece").agg(
        F.min("run_index").alias("lo"), (F.max("run_index") + 1).alias("hi"), F.min(F.when(F.col("changed"), F.col("run_index"))).alias("start_run"),
        F.count(F.when(F.col("open"), 1)).alias("runs"), F.coalesce(F.sum(F.when(F.col("open"), F.col("run_bytes"))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("all_runs"), F.sum("run_bytes").alias("all_bytes"),
    ).drop("bucket", "piece")
    done, levels = None, levels_of(width, span)
    for level in levels:  # the last level's edges are few on any device
        edge = (F.col("lo") % level == 0) | (F.col("hi") % level == 0)
        inner = rows.where(~edge)
        done = inner if done is None else done.unionByName(inner)
        upper = F.floor(F.col("lo") / (level << 10)).cast("long") if level != levels[-1] else F.lit(0).cast("long")
        rows = _joined(rows.where(edge).withColumn("upper", upper)).drop("upper")
    return done.unionByName(rows).where("start_run is not null").select("start_run", "runs", F.col("bytes").cast("long").alias("bytes"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Touching pieces of each ``upper`` as one: from the first changed run on, later pieces count whole."""
    order = Window.partitionBy("upper").orderBy("lo")
    fresh = pieces.withColumn("new", F.when(F.col("lo") == F.lag("hi").over(order), 0).otherwise(1))
    marked = fresh.withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = Window.partitionBy("upper", "piece").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("open", F.coalesce(F.max(F.col("start_run").isNotNull()).over(before), F.lit(False)))
    total = lambda part, whole: F.sum(F.when(F.col("open"), F.col(whole)).otherwise(F.col(part)))
    return marked.groupBy("upper", "piece").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("start_run").alias("start_run"), total("runs", "all_runs").alias("runs"), total("bytes", "all_bytes").alias("bytes"),
        F.sum("all_runs").alias("all_runs"), F.sum("all_bytes").alias("all_bytes"),
    ).drop("piece")


def trim_chunks(islands: DataFrame, most: int = MAX_TRIM) -> DataFrame:
    """Log entries of trims, no longer than ``most`` each, aligned to blocks."""
    parts = islands.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / most).cast("long"))))
    return parts.select((F.col("start_run") * RUN_BLOCKS + F.col("i") * F.lit(most // BLOCK_SIZE)).alias("block"), F.least(F.lit(most), F.col("bytes") - F.col("i") * most).cast("long").alias("length"))


def scan_counters(classified: DataFrame, span: int | None = None) -> DataFrame:
    """Runs, writes, trims (stretches) and written bytes of a scan."""
    trims = trim_islands(classified, span=span).agg(F.count(F.lit(1)).alias("trims"))
    write = F.col("changed") & ~F.col("is_zero")
    runs = classified.agg(F.count(F.lit(1)).alias("total_runs"), F.count(F.when(write, 1)).alias("writes"), F.coalesce(F.sum(F.when(write, F.col("run_bytes"))), F.lit(0)).cast("long").alias("write_bytes"))
    return runs.crossJoin(F.broadcast(trims))  # one row each


def scan(runs: DataFrame, state: DataFrame, zero_hash) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes, trim entries and the next state (``run_index, sha256``) of a scan against the state before."""
    classified = probe(runs, state, zero_hash)
    kept = state.join(classified.select("run_index"), "run_index", "left_anti")
    return changed_writes(classified), trim_chunks(trim_islands(classified)), kept.unionByName(classified.select("run_index", "sha256"))


def in_hole(runs: DataFrame, holes: DataFrame) -> DataFrame:
    """Runs (``lo, hi`` in bytes) that one hole contains whole."""
    from palimpsest.operators.intervals import covers

    asked = runs.withColumnRenamed("lo", "q_lo").withColumnRenamed("hi", "q_hi")
    return covers(holes, asked, width=1 << 22).where("covered").drop("covered").withColumnRenamed("q_lo", "lo").withColumnRenamed("q_hi", "hi")

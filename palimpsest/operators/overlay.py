"""Last-writer-wins overlay of log entries into live extents.

Entries have ``version`` (a total order), ``op``, ``block`` and ``blocks``. Blocks are cut into
buckets. In a bucket, the newest entry that covers it whole hides all older ones, and equal ranges
keep their newest entry alone; only what is left is opened into blocks. So a trim of gigabytes
costs a row a bucket, and a block written a million times costs one. Extents stay one per entry and
contiguous run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.operators.intervals import cut

BUCKET = 256
#: Blocks of an entry on the average, up to which all are opened into blocks.
NARROW = 16


def newest_blocks(entries: DataFrame) -> DataFrame:
    """``blk, version``: the newest entry of each block. Partial maxima combine before the shuffle."""
    each = entries.select("version", F.explode(F.sequence(F.col("block"), F.col("block") + F.col("blocks") - 1)).alias("blk"))
    return each.groupBy("blk").agg(F.max("version").alias("version"))


def _runs(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge touching ``lo, hi`` parts of each version."""
    order = Window.partitionBy(*keys, "version").orderBy("lo")
    fresh = parts.withColumn("__new", F.when(F.col("lo") == F.lag("hi").over(order), 0).otherwise(1))
    run = fresh.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(*keys, "version", "__run").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo")).alias("blocks")).drop("__run")


def newest_runs(entries: DataFrame, keys: list[str] = [], width: int = BUCKET) -> DataFrame:
    """``version, start, blocks``: what the newest entry of each block covers, as maximal runs; per key where keys are given."""
    pieces = cut(entries.select(*keys, "version", F.col("block").alias("lo"), (F.col("block") + F.col("blocks")).alias("hi")), "lo", "hi", width)
    place = [*keys, "bucket"]
    newest = pieces.groupBy(*place, "lo", "hi").agg(F.max("version").alias("version"))
    whole = F.col("hi") - F.col("lo") == width
    floored = newest.withColumn("floor", F.max(F.when(whole, F.col("version"))).over(Window.partitionBy(*place))).where("floor is null or version >= floor")
    # the floor itself stands for one row behind the bucket's last block
    end = (F.col("bucket") + 1) * width
    opened = floored.select(*place, "floor", F.when(~whole, F.col("version")).alias("version"), F.explode(F.when(whole, F.array(end)).otherwise(F.sequence("lo", F.col("hi") - 1))).alias("blk"))
    top = opened.groupBy(*place, "blk").agg(F.max("version").alias("version"), F.max("floor").alias("floor"))
    order = Window.partitionBy(*place).orderBy("blk")
    fresh = F.when((F.col("blk") == F.lag("blk").over(order) + 1) & F.col("version").eqNullSafe(F.lag("version").over(order)), 0).otherwise(1)
    marked = top.withColumn("fresh", fresh).withColumn("behind", F.coalesce(F.lag("blk").over(order) + 1, F.col("bucket") * width))
    marked = marked.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = F.struct(F.col("blk").alias("lo"), (F.col("blk") + 1).alias("hi"), F.col("version").alias("version"), F.col("run").alias("run"))
    under = F.struct(F.col("behind").alias("lo"), F.col("blk").alias("hi"), F.col("floor").alias("version"), (-F.col("blk") - 1).alias("run"))
    parts = marked.select(*place, F.explode(F.array(own, under)).alias("p")).select(*place, "p.*").where("version is not null and lo < hi")
    merged = parts.groupBy(*place, "version", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _runs(merged.select(*keys, "version", "lo", "hi"), keys)


def _by_block(entries: DataFrame) -> DataFrame:
    return _runs(newest_blocks(entries).select("version", F.col("blk").alias("lo"), (F.col("blk") + 1).alias("hi")), [])


def narrow(entries: DataFrame) -> bool:
    """Whether opening every entry into blocks is cheap, from one aggregate: few blocks an entry, and no wide one."""
    seen = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.max("blocks"), F.lit(0)).alias("widest")).first()
    return seen["blocks"] <= NARROW * seen["n"] and seen["widest"] <= BUCKET


def live_extents(entries: DataFrame, plan: str = "auto", width: int = BUCKET) -> DataFrame:
    """The live extents, trims included: ``start, blocks`` and the owning entry's columns (its block as ``ref_block``).

    ``plan="explode"`` opens every entry into blocks, for logs of narrow entries alone; ``"buckets"`` is the plan for any;
    ``"auto"`` looks at the widths first.
    """
    known = entries.where(F.col("op").isin("W", "T"))  # other operations change nothing
    if plan == "auto":
        plan = "explode" if narrow(known) else "buckets"
    live = _by_block(known) if plan == "explode" else newest_runs(known, width=width)
    return live.join(owners(known), "version")


def owners(entries: DataFrame) -> DataFrame:
    """The entries, their own block and length in blocks as ``ref_block`` and ``ref_blocks``."""
    return entries.select("version", *[F.col(c).alias({"block": "ref_block", "blocks": "ref_blocks"}.get(c, c)) for c in entries.columns if c != "version"])


def write_extents(entries: DataFrame, plan: str = "auto") -> DataFrame:
    """The extent map: trims remove coverage."""
    return live_extents(entries, plan).where("op = 'W'")


def remove_segment(extents: DataFrame, segment) -> DataFrame:
    """Drop a segment's extents; what they shadowed stays dead."""
    return extents.where(F.col("segment") != segment)


def merge_adjacent(extents: DataFrame) -> DataFrame:
    """Merge touching extents of one segment and kind: ``segment, op, start, blocks``."""
    order = Window.partitionBy("segment", "op").orderBy("start")
    fresh = extents.withColumn("__new", F.when(F.col("start") == F.lag(F.col("start") + F.col("blocks")).over(order), 0).otherwise(1))
    run = fresh.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy("segment", "op", "__run").agg(F.min("start").alias("start"), F.sum("blocks").alias("blocks")).drop("__run")


def reattribute_segment(extents: DataFrame, old, new) -> DataFrame:
    """Give ``old``'s extents to ``new``, then merge touching extents over the whole map."""
    return merge_adjacent(extents.withColumn("segment", F.when(F.col("segment") == old, F.lit(new)).otherwise(F.col("segment"))))


def apply(state: DataFrame, entries: DataFrame, width: int = BUCKET) -> DataFrame:
    """Fold new entries into a state of ``version, segment, op, start, blocks``: an overlay of both, newest first.

    Only extents that meet a bucket of the new entries are folded; the rest of the state passes by.
    Commutative and idempotent, so redelivered or late segments do no harm.
    """
    new = entries.where(F.col("op").isin("W", "T")).select("version", "segment", "op", "block", "blocks")
    bucket = lambda at: F.floor(at / width).cast("long")
    first, last = bucket(F.col("start")), bucket(F.col("start") + F.col("blocks") - 1)
    touched = new.where("blocks > 0").select(F.explode(F.sequence(bucket(F.col("block")), bucket(F.col("block") + F.col("blocks") - 1))).alias("bucket")).distinct().withColumn("hit", F.lit(True))
    columns = ["version", "segment", "op", "start", "blocks"]
    # an extent within one bucket is asked for once; only wide ones are opened into buckets and brought together again
    narrow = state.select(*columns).where(first == last).withColumn("bucket", first).join(touched, "bucket", "left").select(*columns, F.coalesce("hit", F.lit(False)).alias("hit"))
    wide = state.select(*columns).where(first != last).select(*columns, F.explode(F.sequence(first, last)).alias("bucket")).join(touched, "bucket", "left")
    wide = wide.groupBy(*columns).agg(F.coalesce(F.max("hit"), F.lit(False)).alias("hit"))
    old = narrow.unionByName(wide)
    rows = old.where("hit").select("version", "segment", "op", F.col("start").alias("block"), "blocks").unionByName(new)
    owner = rows.groupBy("version").agg(F.first("segment").alias("segment"), F.first("op").alias("op"))
    folded = newest_runs(rows, width=width).join(owner, "version").select(*columns)
    return old.where("not hit").select(*columns).unionByName(folded)

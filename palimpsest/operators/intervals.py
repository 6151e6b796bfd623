"""Half-open interval sets as DataFrames: union, gaps, containment, clipped lookup.

Lines are cut into buckets so that windows and joins have equality keys: no global sort, no
nested-loop join. Runs that cross buckets are merged level by level, each level seeing only the
intervals that touch a bucket's edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BUCKET = 1024


def cut(df: DataFrame, lo: str, hi: str, width: int = BUCKET) -> DataFrame:
    """Each interval cut at bucket edges: its columns with clipped ends, and ``bucket``. Empty intervals go."""
    first, last = F.floor(F.col(lo) / width).cast("long"), F.floor((F.col(hi) - 1) / width).cast("long")
    rest = [c for c in df.columns if c not in (lo, hi, "bucket")]
    parts = df.where(F.col(lo) < F.col(hi)).withColumn("bucket", F.explode(F.sequence(first, last)))
    return parts.select(*rest, "bucket", F.greatest(F.col(lo), F.col("bucket") * width).alias(lo), F.least(F.col(hi), (F.col("bucket") + 1) * width).alias(hi))


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping and adjacent intervals within each key."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.withColumn("__new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fresh.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__island")


def levels_of(width: int, span: int | None) -> list[int]:
    """The bucket widths whose edges are merged in turn: three where the line's length is not known, fewer on a shorter one."""
    return [level for level in (width, width << 10, width << 20) if span is None or level < span] or [width]


def coalesce(df: DataFrame, keys: list[str] = [], width: int = BUCKET, span: int | None = None) -> DataFrame:
    """The union of intervals ``lo, hi`` per key; overlapping and adjacent ones become one. Columns: keys, lo, hi.

    ``span``, the length of the line where it is known, saves the levels that only a longer one needs.
    """
    rows = cut(df.select(*keys, "lo", "hi"), "lo", "hi", width)
    rows = _islands(rows, [*keys, "bucket"]).select(*keys, "lo", "hi")
    done, levels = None, levels_of(width, span)
    for level in levels:  # the last level's edges are few on any device
        edge = ((F.col("lo") % level == 0) | (F.col("hi") % level == 0))
        inner = rows.where(~edge)
        done = inner if done is None else done.unionByName(inner)
        upper = F.floor(F.col("lo") / (level << 10)).cast("long") if level != levels[-1] else F.lit(0).cast("long")
        rows = _islands(rows.where(edge).withColumn("__upper", upper), [*keys, "__upper"]).select(*keys, "lo", "hi")
    return done.unionByName(rows)


def gaps(df: DataFrame, lo: int, hi: int, width: int = BUCKET) -> DataFrame:
    """The parts of [lo, hi) that no interval covers."""
    spark = df.sparkSession
    covered = _islands(cut(df.select("lo", "hi"), "lo", "hi", width), ["bucket"])
    bucket = F.col("id")  # generated in parallel, however long the range
    frames = spark.range(lo // width, -(-hi // width)).select(bucket.alias("bucket"), F.greatest(F.lit(lo), bucket * width).alias("a"), F.least(F.lit(hi), (bucket + 1) * width).alias("b"))
    inside = frames.join(covered, "bucket", "left")
    order = Window.partitionBy("bucket").orderBy("lo")
    start = F.greatest(F.col("a"), F.coalesce(F.lag("hi").over(order), F.col("a")))
    stop = F.least(F.col("b"), F.coalesce(F.col("lo"), F.col("b")))
    before = inside.select("bucket", "a", "b", "hi", start.alias("glo"), stop.alias("ghi"), F.lead("lo").over(order).isNull().alias("last"))
    parts = before.select(F.col("glo").alias("lo"), F.col("ghi").alias("hi")).where("lo < hi")
    tails = before.where("last and hi is not null").select(F.greatest("hi", "a").alias("lo"), F.col("b").alias("hi")).where("lo < hi")
    return coalesce(parts.union(tails), width=width, span=hi - lo)


def covers(intervals: DataFrame, queries: DataFrame, width: int = BUCKET, span: int | None = None) -> DataFrame:
    """``queries`` (with ``q_lo, q_hi``) and ``covered``: whether one interval of the union holds the whole query."""
    sets = coalesce(intervals, width=width, span=span)
    spread = sets.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width).cast("long"), F.floor((F.col("hi") - 1) / width).cast("long"))))
    keyed = queries.withColumn("bucket", F.floor(F.col("q_lo") / width).cast("long"))
    hits = keyed.join(spread, "bucket", "left").withColumn("__in", (F.col("lo") <= F.col("q_lo")) & (F.col("hi") >= F.col("q_hi")))
    return hits.groupBy(*queries.columns).agg(F.coalesce(F.max("__in"), F.lit(False)).alias("covered"))


def lookup(extents: DataFrame, queries: DataFrame, width: int = BUCKET, keys: list[str] = []) -> DataFrame:
    """Each query (``q_lo, q_hi``) with the parts of extents (``start, blocks``) inside it, clipped; of the same ``keys``, where given.

    An overlap is reported from the bucket where it starts, so a pair that shares several buckets
    gives one row.
    """
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width).cast("long"), F.floor((hi - 1) / width).cast("long")))
    ext = extents.withColumn("bucket", buckets(F.col("start"), F.col("start") + F.col("blocks")))
    ask = queries.where("q_lo < q_hi").withColumn("bucket", buckets(F.col("q_lo"), F.col("q_hi")))
    lo, hi = F.greatest("start", "q_lo"), F.least(F.col("start") + F.col("blocks"), F.col("q_hi"))
    met = ext.join(ask, [*keys, "bucket"]).where((lo < hi) & (F.floor(lo / width) == F.col("bucket")))
    rest = [c for c in extents.columns if c not in ("start", "blocks", *queries.columns)]
    return met.select(*queries.columns, *rest, lo.alias("start"), (hi - lo).alias("blocks"))

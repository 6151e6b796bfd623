"""Sparse cluster images as tables: ``cluster`` and ``data`` (null: trimmed), layered over a base.

A trimmed cluster stays as a row without data, so a base does not show through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.intervals import cut

CLUSTER_BITS = 16


def geometry(cluster, cluster_size: int):
    """Level-one and level-two index of a cluster."""
    entries = (cluster_size - 8) // 8
    return F.floor(cluster / entries).cast("long"), (cluster % entries).cast("long")


def layered(primary: DataFrame, base: DataFrame, cluster_size: int) -> DataFrame:
    """``cluster, data, source``: the primary's cluster, else the base's; trimmed clusters are zeros."""
    p = primary.select("cluster", F.col("data").alias("p"), F.lit(True).alias("in_p"))
    b = base.select("cluster", F.col("data").alias("b"), F.lit(True).alias("in_b"))
    zeros = F.unhex(F.repeat(F.lit("00"), cluster_size))
    source = F.when(F.col("in_p") & F.col("p").isNotNull(), "primary").when(F.col("in_p"), "trimmed").when(F.col("b").isNotNull(), "base").otherwise("zero")
    return p.join(b, "cluster", "full").select("cluster", F.coalesce(F.when(F.col("in_p"), F.coalesce("p", zeros)), "b", zeros).alias("data"), source.alias("source"))


def is_zero(data):
    """Whether all bytes are zero."""
    return data == F.unhex(F.repeat(F.lit("00"), F.length(data)))


def sparse(clusters: DataFrame) -> DataFrame:
    """Without clusters of zeros (conversion and compaction of an image)."""
    return clusters.where(F.col("data").isNotNull() & ~is_zero(F.col("data")))


#: Bytes of pieces, or of an image's clusters, that one task sorts at a time, where their sum is known.
PART_BYTES = 16 << 20


def parts_for(size: int) -> int:
    """Partitions for so many bytes, so that a task holds no more of a larger image."""
    return max(1, -(-size // PART_BYTES))


def from_pieces(pieces: DataFrame, base: DataFrame, cluster_size: int, partial: bool = True, parts: int | None = None) -> DataFrame:
    """Apply disjoint pieces (``offset, length, data``) to clusters: each cluster is rebuilt from its base and pieces in order.

    ``parts``: partitions to deal clusters over (``parts_for``); else the session's setting decides.
    """
    deal = lambda df: df if parts is None else df.repartition(parts, "cluster")
    cuts = cut(pieces.select(F.col("offset").alias("first"), F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), "data"), "lo", "hi", cluster_size)
    own = F.when(F.col("data").isNotNull(), F.substring("data", (F.col("lo") - F.col("first") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    rows = deal(cuts.select(F.col("bucket").alias("cluster"), F.struct((F.col("lo") % cluster_size).alias("at"), (F.col("hi") - F.col("lo")).alias("n"), own.alias("data")).alias("piece")))
    rows = rows.groupBy("cluster").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))  # a cluster's blocks at most
    old = deal(base.select("cluster", F.col("data").alias("old")))
    zero = lambda n: F.unhex(F.repeat(F.lit("00"), n))
    start = F.coalesce("old", zero(F.lit(cluster_size)))
    text = lambda b: F.decode(b, "ISO-8859-1")  # noqa: E731  bytes as characters, so that overlay counts bytes
    built = F.aggregate("pieces", text(start), lambda acc, p: F.overlay(acc, text(F.coalesce(p["data"], zero(p["n"].cast("int")))), (p["at"] + 1).cast("int"), p["n"].cast("int")))
    whole = rows.join(old, "cluster", "full").select("cluster", "old", F.encode(built, "ISO-8859-1").alias("data"), F.col("pieces").isNull().alias("kept"))
    data = F.when(F.col("kept"), F.col("old")).when(~is_zero(F.col("data")), F.col("data"))
    return whole.select("cluster", data.alias("data"))


def to_pieces(clusters: DataFrame, cluster_size: int) -> DataFrame:
    """An image's clusters as pieces for flat files and checksums."""
    return clusters.where("data is not null").select((F.col("cluster") * cluster_size).alias("offset"), F.lit(cluster_size).cast("long").alias("length"), "data")

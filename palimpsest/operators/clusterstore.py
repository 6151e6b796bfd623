"""A base image as a stored table of clusters in zones: upserts touch their zones alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.sources.zones import Zones

#: Clusters of a zone: 256 MiB of 64 KiB clusters.
ZONE_CLUSTERS = 1 << 12
COLUMNS = "cluster bigint, data binary"


class ClusterStore:
    """``cluster, data`` (null data: zeros), the latest write of a cluster wins."""

    def __init__(self, spark: SparkSession, path: str, zone_clusters: int = ZONE_CLUSTERS):
        self.zones, self.zone_clusters = Zones(spark, path, COLUMNS), zone_clusters

    def _zoned(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.floor(F.col("cluster") / self.zone_clusters).cast("long").alias("zone"), "cluster", "data")

    def _merged(self, stored: DataFrame) -> DataFrame:
        newest = stored.groupBy("cluster").agg(F.max(F.struct("turn", "data")).alias("last"))
        return newest.select("cluster", "last.data")

    def upsert(self, rows: DataFrame) -> list[int]:
        """Write clusters (each once) over what is there; the zones that were written."""
        zones = self.zones.append(self._zoned(rows))
        self.zones.compact(self.zones.crowded(zones), lambda rows: self._zoned(self._merged(rows)))
        return zones

    def replace(self, rows: DataFrame) -> None:
        """Put a new base in the old one's place; batches that begin from now on read the new one, whole."""
        self.zones.replace(self._zoned(rows))

    def clusters(self) -> DataFrame:
        return self._merged(self.zones.read(self.zones.deltas()))

    def of(self, asked: DataFrame) -> DataFrame:
        """The stored ones among ``asked`` (``cluster``; a batch's, few), read from their zones alone."""
        wanted = {r["z"] for r in asked.select(F.floor(F.col("cluster") / self.zone_clusters).cast("long").alias("z")).distinct().collect()}
        found = self.zones.read(self.zones.deltas(lambda z: z in wanted))
        return self._merged(found.join(asked.select("cluster").distinct(), "cluster", "left_semi"))

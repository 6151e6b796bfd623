"""The live map as a stored table in zones of blocks.

A fold looks at its own entries alone: what is newest among them goes to a delta in each touched zone, and nothing that
is stored is read. A reader merges a zone's deltas by the newest version, so folds may come late, twice or in any order. A zone
that has gathered many deltas is compacted on its own. The newest folded label is published with the deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.operators.intervals import cut
from palimpsest.operators.overlay import newest_runs
from palimpsest.sources.zones import Zones

#: Blocks of a zone: 1 GiB of 4 KiB blocks.
ZONE_BLOCKS = 1 << 18
COLUMNS = "version struct<segment:string,entry_index:bigint>, segment string, op string, start bigint, blocks bigint"


class LiveMap:
    def __init__(self, spark: SparkSession, path: str, zone_blocks: int = ZONE_BLOCKS):
        self.zones, self.zone_blocks = Zones(spark, path, COLUMNS), zone_blocks

    def manifest(self) -> list[tuple[int, str, str]]:
        return self.zones.manifest()

    def label(self) -> str | None:
        """The newest label that was folded; none before the first fold."""
        return max((label for _, _, label in self.manifest() if label), default=None)

    def _cut(self, extents: DataFrame) -> DataFrame:
        parts = cut(extents.select("version", "segment", "op", F.col("start").alias("lo"), (F.col("start") + F.col("blocks")).alias("hi")), "lo", "hi", self.zone_blocks)
        return parts.select(F.col("bucket").alias("zone"), "version", "segment", "op", F.col("lo").alias("start"), (F.col("hi") - F.col("lo")).alias("blocks"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest runs of ``version, segment, op, block, blocks``. The owner rides on the version, which it does not reorder, so the rows are read once."""
        owned = rows.select(F.struct("version", "segment", "op").alias("version"), "block", "blocks")
        return newest_runs(owned).select("version.version", "version.segment", "version.op", "start", "blocks")

    def _merged(self, stored: DataFrame) -> DataFrame:
        return self._newest(stored.select("version", "segment", "op", F.col("start").alias("block"), "blocks"))

    def fold(self, entries: DataFrame, label: str = "") -> list[int]:
        """Fold entries (``version, segment, op, block, blocks``) in; the zones that were written. ``label``: the newest segment among them."""
        new = entries.where(F.col("op").isin("W", "T")).where("blocks > 0").select("version", "segment", "op", "block", "blocks")
        zones = self.zones.append(self._cut(self._newest(new)), label)
        self.compact(self.zones.crowded(zones))
        return zones

    def compact(self, zones: list[int]) -> None:
        """Merge the deltas of each of these zones into one; other zones' files stay as they are."""
        self.zones.compact(zones, lambda rows: self._cut(self._merged(rows)))

    def extents(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """``version, segment, op, start, blocks`` of the live map; with ``lo`` and ``hi``, of the zones that meet those blocks, read from those zones' files alone.

        An extent that crosses zones comes whole where it is read whole.
        """
        first, last = (None if lo is None else lo // self.zone_blocks), (None if hi is None else (hi - 1) // self.zone_blocks)
        return self._merged(self.zones.read(self.zones.deltas(lambda z: (first is None or z >= first) and (last is None or z <= last))))

    def at(self, zones: list[int]) -> DataFrame:
        """As ``extents``, of the named zones alone."""
        wanted = set(zones)
        return self._merged(self.zones.read(self.zones.deltas(lambda z: z in wanted)))

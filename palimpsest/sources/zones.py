"""Tables stored in zones of a line, with a small delta a write in each zone that it touches.

A write makes a new folder with a Parquet folder a zone, and reads nothing. Which folders make up which zone is a small snapshot
(``state``), published by a rename: a write that fails leaves the old one. A zone's deltas are merged by those who read them, and
compacted zone by zone. What a compaction replaces stays readable until the next one of that zone.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.sources import state

MANIFEST = "place int, zone long, folder string, label string"
#: Zones of manifest rows that are no deltas: a label alone, and a replaced folder.
LABEL, REPLACED = -1, -2
#: Deltas of a zone beyond which it is compacted.
MAX_DELTAS = 8

Row = tuple[int, str, str]


@dataclass
class Zones:
    """``path`` holds ``data/`` (a folder a write, in it a folder a zone) and ``manifest/``; ``columns`` are those of a zone's files."""

    spark: SparkSession
    path: str
    columns: str

    def manifest(self) -> list[Row]:
        """Zone, folder and newest label of each delta, in the order in which they were made."""
        rows = state.load(self.spark, f"{self.path}/manifest")
        return [] if rows is None else [tuple(r) for r in rows.orderBy("place").select("zone", "folder", "label").collect()]  # a row a zone and write since its compaction

    def deltas(self, chosen: Callable[[int], bool] = lambda zone: True) -> list[Row]:
        return [r for r in self.manifest() if r[0] >= 0 and chosen(r[0])]

    def publish(self, rows: list[Row]) -> None:
        state.save(self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], MANIFEST).coalesce(1), f"{self.path}/manifest")

    def write(self, rows: DataFrame, label: str = "") -> list[Row]:
        """Write rows with their ``zone`` as a new folder, not yet published; its manifest rows."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition("zone").write.partitionBy("zone").parquet(folder)
        fs, p = state._fs(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return [(int(n.removeprefix("zone=")), folder, label) for n in sorted(names) if n.startswith("zone=")]

    def read(self, rows: list[Row]) -> DataFrame:
        """What some deltas hold, with ``turn``, the delta's place among them."""
        found = None
        for turn, folder in enumerate(dict.fromkeys(f for _, f, _ in rows)):
            part = self.spark.read.schema(self.columns).parquet(*[f"{folder}/zone={z}" for z, f, _ in rows if f == folder]).withColumn("turn", F.lit(turn))
            found = part if found is None else found.unionByName(part)
        return self.spark.createDataFrame([], self.columns).withColumn("turn", F.lit(0)) if found is None else found

    def append(self, rows: DataFrame, label: str = "") -> list[int]:
        """Write and publish a delta; the zones that it touches. A label without rows is kept too."""
        made, before = self.write(rows, label), self.manifest()
        if made or label:
            self.publish([r for r in before if made or r[0] != LABEL] + (made or [(LABEL, "", label)]))
        return sorted({z for z, _, _ in made})

    def crowded(self, zones: list[int], most: int = MAX_DELTAS) -> list[int]:
        held = Counter(z for z, _, _ in self.manifest())
        return [z for z in zones if held[z] > most]

    def compact(self, zones: list[int], merged: Callable[[DataFrame], DataFrame]) -> None:
        """Put one delta in place of each zone's; ``merged`` gives its rows, with ``zone``, from those of ``read``. Other zones' files stay as they are."""
        rows, wanted = self.manifest(), {z for z in zones if z >= 0}
        old = [r for r in rows if r[0] in wanted]
        if not old:
            return
        made = self.write(merged(self.read(old)), max(label for _, _, label in old))
        replaced = [(REPLACED, f"{folder}/zone={z}", "") for z, folder, _ in old]
        # what was replaced before, of these zones, nobody reads any more
        dead = [r for r in rows if r[0] == REPLACED and int(r[1].rsplit("=", 1)[1]) in wanted]
        self.publish([r for r in rows if r not in set(old) and r not in set(dead)] + made + replaced)
        fs, _ = state._fs(self.spark, self.path)
        for _, path, _ in dead:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def replace(self, rows: DataFrame) -> None:
        """Put other rows in the place of all: readers that begin from now on see these alone."""
        before = self.manifest()
        self.publish(self.write(rows) + [(REPLACED, f"{f}/zone={z}", "") for z, f, _ in before if z >= 0] + [r for r in before if r[0] == REPLACED])

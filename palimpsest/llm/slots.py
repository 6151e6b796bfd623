"""Sharding by fixed virtual slots, with DataFrame functions (operator 12).

A record's hash puts it into one of a few thousand slots, for good. Bytes are added up by slot, and a stored table maps
slots to shards. It has versions: the first deals the slots out in turn, and rebalancing (or another number of shards) edits
the newest into the next, moving slots from shards above their share alone. What the driver sees is the slots' sums, a few
thousand rows whatever the corpus. A slot that a hot key makes too heavy for one shard is dealt in parts. A record's place in its shard
is the count of what lies in earlier cells of the shard plus its place in its own cell, so no task orders a shard.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.runtime import Scratch, scratch_path

SLOTS, SHARDS = 4096, 24
#: Bytes of a record beside its text.
OVERHEAD = 8
#: Rows of a cell, in which records are numbered by one task, about; slots of more rows have several cells.
CELL_ROWS = 1 << 16
#: A slot of more rows than a cell's is dealt in parts where it holds more than this share of a shard.
HEAVY = 1 / 8

MAP = "slot int, part int, parts int, shard int"


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, salt``: the slot comes from the MD5 of the id (null: empty) and the text's CRC-32, as an id may stand beside several texts.

    ``salt`` is random: it deals rows that are equal in all columns over the parts of a heavy slot.
    """
    if slots & (slots - 1) or not 0 < slots <= 1 << 16:
        raise ValueError("slots must be a power of two, 65,536 at most")
    data = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    slot = F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int") % slots
    return rows.withColumn("virtual_slot", slot).withColumn("salt", F.floor(F.rand() * (1 << 30)).cast("int"))


def slot_sums(rows: DataFrame) -> DataFrame:
    """``slot, n, bytes``: a row a slot at most."""
    return rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def first_map(sums: list, slots: int = SLOTS, shards: int = SHARDS, cell_rows: int = CELL_ROWS) -> list[tuple[int, int, int, int]]:
    """``slot, part, parts, shard`` of every slot, dealt out in turn; a heavy slot's parts follow one another."""
    total, of = sum(r["bytes"] for r in sums), {r["slot"]: r for r in sums}
    out = []
    for slot in range(slots):
        r, parts = of.get(slot), 1
        if r is not None and r["n"] > cell_rows and r["bytes"] * shards > HEAVY * total:
            parts = min(4 * shards, int(r["bytes"] * shards / (HEAVY * total)) + 1)
        out += [(slot, p, parts, (slot + p) % shards) for p in range(parts)]
    return out


def edited(map_: list[tuple[int, int, int, int]], sums: list, shards: int = SHARDS) -> list[tuple[int, int, int, int]]:
    """The map after rebalancing over ``shards``.

    Each shard keeps its largest slots, in order of bytes, until the next would bring it above an equal share; slots of
    shards that are no more go too. What is left over moves, the largest first, to the shard that holds the least.
    """
    of = {r["slot"]: r["bytes"] for r in sums}
    weight = {(slot, part): of.get(slot, 0) // parts for slot, part, parts, _ in map_}
    share, held, loads, free, placed = sum(of.values()) / shards, defaultdict(list), [0] * shards, [], {}
    for slot, part, parts, shard in map_:
        (held[shard] if shard < shards else free).append((-weight[slot, part], slot, part))
    for shard, own in held.items():
        for i, (w, slot, part) in enumerate(sorted(own)):
            if loads[shard] - w > share:
                free += sorted(own)[i:]
                break
            loads[shard] -= w
            placed[slot, part] = shard
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for w, slot, part in sorted(free):
        load, shard = heapq.heappop(heap)
        placed[slot, part] = shard
        heapq.heappush(heap, (load - w, shard))
    return [(slot, part, parts, placed[slot, part]) for slot, part, parts, _ in map_]


class SlotMap:
    """The stored map: a Parquet folder a version, each the whole map; a version is never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def load(self, version: int | None = None) -> DataFrame:
        """A version (the newest where none is named): ``slot, part, parts, shard``."""
        return self.spark.read.schema(MAP).parquet(f"{self.path}/version={self.versions()[-1] if version is None else version}")

    def rows(self, version: int | None = None) -> list[tuple[int, int, int, int]]:
        return sorted(tuple(r) for r in self.load(version).collect())  # a row a slot and part

    def save(self, rows: list[tuple[int, int, int, int]]) -> int:
        """Store the next version; its number."""
        version = (self.versions() or [-1])[-1] + 1
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{self.path}/version={version}")
        return version

    def rebalance(self, sums: list, shards: int) -> int:
        """Edit the newest version for these sums and number of shards into the next one; its number."""
        return self.save(edited(self.rows(), sums, shards))


def placed(rows: DataFrame, map_: DataFrame, sums: list, slots: int = SLOTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` of ``slotted`` with ``shard`` and ``slot``, the place in the shard, gapless from 0.

    A shard's records lie by virtual slot, part and cell, in a cell by id and checksum. A slot of few rows is one cell.
    """
    cells = [1] * slots
    for r in sums:
        cells[r["slot"]] = -(-r["n"] // cell_rows)
    listed = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<int>")  # one literal, folded
    own = map_.select(F.col("slot").alias("virtual_slot"), "part", "parts", "shard")
    parts = map_.groupBy(F.col("slot").alias("virtual_slot")).agg(F.first("parts").alias("of"))
    dealt = rows.join(parts, "virtual_slot").withColumn("part", F.col("salt") % F.col("of")).drop("of")
    dealt = dealt.withColumn("cell", F.floor(F.col("salt") / F.lit(128)).cast("int") % F.get(listed, F.col("virtual_slot")))
    dealt = dealt.join(own, ["virtual_slot", "part"])
    place = ["virtual_slot", "part", "cell"]
    counts = dealt.groupBy("shard", *place).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*place, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*place).orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size"))
    return dealt.withColumn("within", within - 1).join(before, place).withColumn("slot", (F.col("before") + F.col("within")).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, path: str | None = None, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version`` per row, under the law ``bytes``: shards hold nearly equal sizes.

    The map is kept at ``path`` (default: a scratch folder): where there is one already it is edited for these rows and this
    number of shards, else dealt out and edited. Null texts have no bytes. Rows of one id and several texts may lie in
    different shards; rows equal in both share a slot, and so a shard unless the slot is heavy. An empty table gives no rows
    and an even map. Other columns are ignored, whatever their names. ``grown_shard`` belongs to another law and is null.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.stored(slotted(docs, id_col, text_col, slots), "slotted")  # the salt is fixed from here on
    sums = slot_sums(rows).collect()  # a row a slot
    kept = SlotMap(spark, path or scratch_path(spark, "slot-map"))
    if not kept.versions():
        kept.save(first_map(sums, slots, shards, cell_rows))
    version = kept.rebalance(sums, shards)
    made = placed(rows, kept.load(version), sums, slots, cell_rows)
    columns = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version")]
    result = Scratch(spark).stored(made.select(*columns), "sharded")
    scratch.drop()
    return result

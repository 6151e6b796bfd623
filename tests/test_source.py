"""The log format as a Spark source and sink, late payload reads, numbering, and the live map in zones."""

import hashlib
import os
import random

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.checks import lz4_pack
from palimpsest.operators import jobs, liveness, overlay
from palimpsest.operators.livestore import LiveMap
from palimpsest.operators.numbering import numbered, parts_of
from palimpsest.sources import blocklog, logformat, payload
from palimpsest.sources.cbor import dumps
from palimpsest.sources.pull import CHUNK, Damaged, Pull, read_entries, read_header

from test_log import B, image_of, t, w, write

LABEL = "40000000650000{:02d}00000000"


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rng = random.Random(4)
    for i in range(5):
        write(folder, LABEL.format(i), [w(b, n, rng.choice("ABC")) if rng.random() < 0.7 else t(b, n) for b, n in ((rng.randrange(200), rng.randint(1, 30)) for _ in range(20))])
    return folder


# ---- reading

def test_entries_equal_the_codec(spark, log):
    got = {(r["segment"], r["entry_index"]): r for r in logformat.read(spark, str(log)).collect()}
    for f in sorted(log.iterdir()):
        label = f.name[5:-4]
        header, entries = blocklog.decode(f.read_bytes())
        for i, e in enumerate(entries):
            r = got.pop((label, i))
            assert {k: r[k] for k in e} == e and r["block_size"] == header["block_size"] and r["error"] is None
            if e["data"]:
                stored = f.read_bytes()[r["data_offset"] : r["data_offset"] + r["compressed_size"]]
                assert stored == lz4_pack(e["data"]) and r["entry_offset"] < r["data_offset"]
    assert not got


def test_conditions_are_pushed_down_and_older_files_stay_closed(spark, log, capsys):
    for i in (0, 1):
        (log / f"disk.{LABEL.format(i)}.log").write_bytes(b"\xff no segment")
    (log / f"disk.{LABEL.format(9)}.log.tmp").write_bytes(b"")
    pushing = lambda: spark.read.format("blocklog").option("push_filters", "true").load(str(log))
    logformat.register(spark)
    new = lambda: pushing().where((F.col("segment") > LABEL.format(1)) & (F.col("op") == "W") & (F.col("length") > B))
    new().explain("formatted")
    plan = capsys.readouterr().out
    assert f"GreaterThan(segment,{LABEL.format(1)})" in plan and "EqualTo(op,W)" in plan
    assert {r["segment"] for r in new().collect()} == {LABEL.format(i) for i in (2, 3, 4)}
    assert new().rdd.getNumPartitions() == 3  # a segment a partition
    count = lambda condition: pushing().where(condition).count()
    assert count(F.col("segment").isin(LABEL.format(3), "x")) == count(F.col("segment").startswith(LABEL.format(4))) == 20
    assert count(f"segment between '{LABEL.format(2)}' and '{LABEL.format(3)}'") == 40 and count("segment = 'none'") == count("segment < '4'") == 0
    trims = pushing().where(f"op = 'T' and segment >= '{LABEL.format(2)}'").collect()
    assert trims and all(r["op"] == "T" and r["data"] is None for r in trims)
    # options do the same, and the DataFrame can be used in several ways
    later = logformat.read(spark, str(log), after=LABEL.format(1))
    assert later.count() == 60 and later.where(f"segment = '{LABEL.format(2)}'").union(later.where(f"segment = '{LABEL.format(4)}'")).count() == 40 and later.count() == 60
    assert logformat.read(spark, str(log), segments=[LABEL.format(3), "x"]).count() == 20 and logformat.read(spark, str(log), segments=[]).count() == 0
    with pytest.raises(Exception, match="segment " + LABEL.format(0)):
        logformat.read(spark, str(log)).count()
    assert logformat.read(spark, str(log), include_tmp=True, mode="PERMISSIVE").where("error is not null").count() == 3


def test_payload_is_read_only_where_selected(log):
    path = log / f"disk.{LABEL.format(0)}.log"
    data = bytes(random.Random(1).randbytes(1 << 20))
    path.write_bytes(blocklog.encode_header("x", B, 1 << 30) + b"".join(blocklog.encode_entry("W", 1, i, i * 256, len(data), data) for i in range(4)) + blocklog.encode_entry("T", 1, 4, 0, B))
    size = path.stat().st_size
    read = {}
    for name, args in {"all": (True, None), "none": (False, None), "trims": (True, {"T"})}.items():
        with open(path, "rb") as f:
            pull = Pull(f, size)
            read_header(pull)
            rows = list(read_entries(pull, *args))
            read[name] = pull.bytes_read
        assert len(rows) == 5 and (rows[0]["data"] == data) == (name == "all")
    assert read["all"] >= size and read["none"] < size // 50 and read["trims"] < size // 50


class Endless:
    """A segment of many equal entries, made as it is read; keeps the longest read."""

    def __init__(self, entry: bytes, n: int):
        self.head, self.entry, self.at, self.longest = blocklog.encode_header("x", B, 1 << 40), entry, 0, 0
        self.size = len(self.head) + n * len(entry)

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.longest = max(self.longest, n)
        out = bytearray()
        while n > 0 and self.at < self.size:
            source, i = (self.head, self.at) if self.at < len(self.head) else (self.entry, (self.at - len(self.head)) % len(self.entry))
            part = source[i : i + n]
            out += part
            self.at += len(part)
            n -= len(part)
        return bytes(out)


def test_three_gigabytes_in_bounded_memory():
    data = random.Random(2).randbytes(1 << 20)
    entry = blocklog.encode_entry("W", 1, 0, 0, len(data), data)
    file = Endless(entry, 3 * 1024 + 1)
    pull = Pull(file, file.size)
    read_header(pull)
    n, largest = 0, 0
    for e in read_entries(pull, payload=n % 2 == 0):
        n += 1
        largest = max(largest, len(pull.buffer))
        assert n % 512 or zlib.crc32(e["data"]) == e["checksum"]
    assert file.size > 3 << 30 and n == 3 * 1024 + 1 and max(largest, file.longest) < len(entry) + 2 * CHUNK


def test_entries_and_error_come_in_one_pass(spark, tmp_path):
    good = blocklog.encode_header("a", B, 1 << 20) + blocklog.encode_entry("W", 1, 0, 0, B, b"x" * B)
    bad_pack = dumps({1: "W", 2: 1, 3: 1, 4: 0, 5: B, 6: 1, 7: b"\xf0\x01"})
    cases = {
        "short": good[:-3], "none": b"", "header": good[:9], "tail": good + b"\xa1\x01", "kind": good + b"\x01", "long": good + b"\x5f", "pack": good + bad_pack, "text": good + dumps({1: 5}), "number": good + dumps({1: "W", 4: "x"}),
        "deep": good + b"\xa1\x18\x63" + b"\x81" * 500, "huge": good + b"\xa1\x01\x7b\x00\x00\x00\xff\xff\xff\xff\xff", "fine": good, "extra": good + dumps({1: "T", 2: 1, 3: 1, 4: 0, 5: B, 99: [1, {2: b"x"}, 1.5, None]}),
    }
    for name, raw in cases.items():
        (tmp_path / f"disk.{name}.log").write_bytes(raw)
    rows = logformat.read(spark, str(tmp_path), mode="PERMISSIVE").collect()
    entries, errors = Counter(r["segment"] for r in rows if r["op"]), {r["segment"]: r["error"] for r in rows if r["error"]}
    assert set(errors) == set(cases) - {"fine", "extra"} and all("byte" in e or e for e in errors.values())
    assert entries == {name: 2 if name == "extra" else 1 for name in cases if name not in ("short", "none", "header")}
    assert logformat.read(spark, str(tmp_path), mode="DROPMALFORMED").count() == sum(entries.values())
    for name in ("short", "pack"):
        with pytest.raises(Exception, match=f"segment {name}"):
            logformat.read(spark, str(tmp_path), segments=[name]).collect()
    with pytest.raises(Exception, match="mode is one of"):
        logformat.read(spark, str(tmp_path), mode="LENIENT").collect()
    # geometry alone does not unpack, so a bad payload is no error there
    assert logformat.read(spark, str(tmp_path), ["segment", "op"], segments=["pack"]).count() == 2


def test_pull_refuses_what_is_no_log(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"\x83\x01\x02\x03")
    with open(path, "rb") as f, pytest.raises(Damaged):
        read_header(Pull(f, 4))


def test_no_segments_and_no_folder(spark, tmp_path):
    assert logformat.read(spark, str(tmp_path)).count() == 0
    assert logformat.read(spark, str(tmp_path / "nowhere")).count() == 0


# ---- writing

def rows_of(spark, n=40, labels=4):
    return spark.range(n).select(
        F.format_string("s%02d", F.col("id") % labels).alias("segment"), F.when(F.col("id") % 5 == 0, "T").otherwise("W").alias("op"), F.col("id").alias("timestamp_ns"), F.col("id").alias("sequence"),
        (F.col("id") * 3).alias("block"), F.lit(B).cast("long").alias("length"), F.when(F.col("id") % 5 != 0, F.encode(F.repeat(F.chr(65 + F.col("id")), B), "ISO-8859-1")).alias("data"), F.lit(None).cast("long").alias("checksum"), F.lit(1).alias("clash"),
    )


def test_write_and_read_back(spark, tmp_path):
    folder = str(tmp_path / "made" / "log")
    rows = rows_of(spark).repartition(7)
    logformat.write_log(rows, folder, B, 1 << 20, "/x")
    assert sorted(os.listdir(folder)) == [f"disk.s{i:02d}.log" for i in range(4)]
    back = logformat.read(spark, folder)
    key = lambda df: sorted(tuple(r) for r in df.select("segment", "sequence", "op", "timestamp_ns", "block", "length", F.sha2("data", 256)).collect())
    assert key(back) == key(rows) and back.where("op = 'W' and checksum <> crc32(data)").count() == 0
    header, entries = blocklog.decode((tmp_path / "made" / "log" / "disk.s01.log").read_bytes())
    assert header == {"version": 2, "block_size": B, "segment_label": "s01", "device_size": 1 << 20, "backing_path": "/x"}
    assert [e["sequence"] for e in entries] == sorted(e["sequence"] for e in entries)
    # an empty table writes nothing; overwriting leaves the new segments alone
    logformat.write_log(rows.where("false"), folder, B)
    logformat.write_log(rows.where("segment = 's02'"), folder, B, mode="overwrite")
    assert os.listdir(folder) == ["disk.s02.log"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "log")
    logformat.write_log(rows_of(spark), folder, B)
    before = {f: open(f"{folder}/{f}", "rb").read() for f in sorted(os.listdir(folder))}
    with pytest.raises(Exception, match="written twice"):
        logformat.write_log(rows_of(spark, labels=5), folder, B)
    broken = rows_of(spark).withColumn("segment", F.concat(F.lit("n"), "segment")).withColumn("block", F.when(F.col("sequence") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("block")))
    with pytest.raises(Exception, match="lost"):
        logformat.write_log(broken, folder, B)
    torn = rows_of(spark).withColumn("segment", F.concat(F.lit("n"), "segment")).repartition(3, "sequence")
    with pytest.raises(Exception, match="come together|written twice|out of order"):
        torn.write.format("blocklog").mode("append").save(folder)
    assert {f: open(f"{folder}/{f}", "rb").read() for f in sorted(os.listdir(folder))} == before


# ---- numbering

def test_numbering_equals_one_pass(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(9), i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "cell int, i int, size int").repartition(6)
    got = {r["i"]: (r["sequence"], r["before"], r["part"]) for r in parts_of(numbered(df, ["cell"], ["i"], F.col("size")), 1000).collect()}
    total = 0
    for n, (_, i, size) in enumerate(sorted(rows)):
        assert got[i] == (n, total, total // 1000)
        total += size
    assert numbered(df.where("false"), ["cell"], ["i"]).collect() == []


# ---- late payloads, repack

def test_only_live_bytes_are_read(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    data = [random.Random(i).randbytes(64 * B) for i in range(8)]
    for i, d in enumerate(data):  # seven of eight are hidden
        (folder / f"disk.l{i}.log").write_bytes(blocklog.encode_header(f"l{i}", B, 1 << 20) + blocklog.encode_entry("W", i, 0, 0, len(d), d))
    write(folder, "l9", [t(10, 4)])
    pieces = payload.live_pieces(payload.index(spark, str(folder)), str(folder)).collect()
    stored = len(lz4_pack(data[7]))
    assert sum(r["fetched"] for r in pieces) == stored  # one entry, read once for both of its ranges
    content = bytearray(1 << 20)
    for r in pieces:
        content[r["offset"] : r["offset"] + r["length"]] = r["data"] or bytes(r["length"])
    assert bytes(content) == image_of(folder)
    for i in range(7):  # the hidden payloads may as well be lost
        path = folder / f"disk.l{i}.log"
        raw = bytearray(path.read_bytes())
        raw[200:] = bytes(len(raw) - 200)
        path.write_bytes(raw)
    out = tmp_path / "flat"
    counters = jobs.replay_flat(spark, str(folder), str(out), verify=False)
    assert out.read_bytes() == bytes(content) and counters["entries"] == 9 and counters["crc_errors"] is None
    assert jobs.log_checksum(spark, str(folder)) == hashlib.sha256(content).hexdigest()
    jobs.repack(spark, str(folder), str(tmp_path / "packed"), "p")
    assert image_of(tmp_path / "packed") == bytes(content)


def test_repack_writes_bounded_segments_in_order(spark, log, tmp_path):
    want = image_of(log)
    out = tmp_path / "packed"
    first = LABEL.format(50)
    labels = jobs.repack(spark, str(log), str(out), first, segment_bytes=64 * B)
    assert len(labels) > 2 and labels == sorted(labels) and labels[0] == first and blocklog.list_segments(spark, str(out)) == labels
    assert image_of(out) == want
    seen = []
    for label in labels:
        _, entries = blocklog.decode((out / f"disk.{label}.log").read_bytes())
        assert sum(e["length"] for e in entries[:-1] if e["op"] == "W") < 32 * B
        assert all(e["op"] == "T" or zlib.crc32(e["data"]) == e["checksum"] for e in entries)
        seen += [(e["sequence"], e["timestamp_ns"]) for e in entries]
    assert [s for s, _ in seen] == list(range(len(seen)))
    flat = tmp_path / "flat"
    jobs.replay_flat(spark, str(out), str(flat))
    assert flat.read_bytes() == want


def test_scan_writes_several_segments(spark, tmp_path):
    run, folder = 61440, tmp_path / "log"
    folder.mkdir()
    content = bytes(run * 3) + random.Random(3).randbytes(run * 6 + 100) + bytes(run * 2)
    (tmp_path / "dev").write_bytes(content)
    from palimpsest.sources import imagefile

    label = LABEL.format(7)
    got = jobs.scan_runs(spark, imagefile.read_runs(spark, str(tmp_path / "dev")), str(tmp_path / "h"), str(folder), label, len(content), 5, segment_bytes=4 * run)
    labels = blocklog.list_segments(spark, str(folder))
    assert labels[0] == label and len(labels) >= 3 and got["writes"] == 7 and got["write_bytes"] == 7 * run and got["trims"] == 2 and got["total_runs"] == 12
    rows = logformat.read(spark, str(folder)).orderBy("segment", "entry_index").collect()
    assert [r["sequence"] for r in rows] == list(range(len(rows))) and [r["block"] for r in rows] == sorted(r["block"] for r in rows)
    out = tmp_path / "flat"
    jobs.replay_flat(spark, str(folder), str(out))
    assert out.read_bytes()[: len(content)] == content


# ---- the live map in zones

def live_of(df):
    return sorted((r["start"], r["blocks"], r["segment"], r["version"]["entry_index"], r["op"]) for r in df.collect())


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(os.path.join(path, "data")) for f in names if f.endswith(".parquet")}


def test_folds_touch_their_zones_alone(spark, log, tmp_path):
    index = payload.index(spark, str(log))
    want = live_of(payload.live_ranges(index))
    path = str(tmp_path / "map")
    live = LiveMap(spark, path, zone_blocks=32)
    for i in (3, 0, 4, 1, 2, 0):  # out of order, and one twice
        live.fold(index.where(F.col("segment") == LABEL.format(i)), LABEL.format(i))
    assert live_of(live.extents()) == want and live.label() == LABEL.format(4)
    before = files(path)
    new = tmp_path / "new"
    new.mkdir()
    write(new, LABEL.format(8), [w(70, 3, "Z"), t(90, 1)])
    assert live.fold(payload.index(spark, str(new)), LABEL.format(8)) == [2]
    after = files(path)
    assert {k: v for k, v in after.items() if k in before} == before
    assert all("zone=2" in f for f in set(after) - set(before)) and len(set(after) - set(before)) == 1
    part = live_of(live.extents(64, 96))
    assert part and all(64 <= s < 96 for s, *_ in part) and (70, 3, LABEL.format(8), 0, "W") in part
    # zones of other blocks are not opened
    for f in after:
        if "zone=2" not in f:
            with open(os.path.join(path, f), "r+b") as x:
                x.truncate(3)
    assert live_of(live.extents(64, 96)) == part and live_of(live.at([2])) == part


def test_compaction_of_one_zone(spark, tmp_path):
    path = str(tmp_path / "map")
    live = LiveMap(spark, path, zone_blocks=16)
    schema = "version struct<segment:string,entry_index:bigint>, segment string, op string, block bigint, blocks bigint"
    entry = lambda s, i, op, b, n: ((s, i), s, op, b, n)
    log = []
    for i in range(12):
        rows = [entry(f"s{i:02d}", 0, "W", (i * 3) % 16, 2)] + ([entry(f"s{i:02d}", 1, "T", 40, 30)] if i == 0 else [])
        log += rows
        live.fold(spark.createDataFrame(rows, schema), f"s{i:02d}")
    zones = Counter(z for z, _, _ in live.manifest() if z >= 0)
    assert zones[0] < 9 and zones[2] == zones[3] == zones[4] == 1
    want = live_of(overlay.live_extents(spark.createDataFrame(log, schema)))
    assert live_of(live.extents()) == want and live.label() == "s11"
    live.compact([0, 1, 2, 99])
    assert live_of(live.extents()) == want and Counter(z for z, _, _ in live.manifest() if z >= 0)[0] == 1
    live.fold(spark.createDataFrame([], schema), "s12")
    assert live.label() == "s12" and live_of(live.extents()) == want
    empty = LiveMap(spark, str(tmp_path / "none"))
    assert empty.extents().count() == 0 and empty.label() is None and empty.fold(spark.createDataFrame([], schema)) == []


def test_gc_in_turns_opens_new_segments_alone(spark, log):
    before = image_of(log)
    jobs.live_map(spark, str(log))
    # older segments are not needed for the map any more
    old = {i: (log / f"disk.{LABEL.format(i)}.log").read_bytes() for i in range(5)}
    for i in old:
        (log / f"disk.{LABEL.format(i)}.log").write_bytes(b"\xff")
    write(log, LABEL.format(10), [w(0, 100, "Q")])
    got = live_of(jobs.live_map(spark, str(log)))
    for i, raw in old.items():
        (log / f"disk.{LABEL.format(i)}.log").write_bytes(raw)
    assert got == live_of(jobs.live_map(spark, str(log), full=True)) and image_of(log) != before
    result = jobs.gc(spark, str(log), 60)
    assert result.retired and result.deleted == len(result.retired)
    totals = {r["segment"]: r for r in result.stats}
    whole = {r["segment"]: r for r in liveness.segment_totals(payload.index(spark, str(log))).collect()}
    assert all(totals[s]["total_entries"] == whole[s]["total_entries"] for s in whole if s in totals)
    assert live_of(jobs.live_map(spark, str(log))) == live_of(jobs.live_map(spark, str(log), full=True))

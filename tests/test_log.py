"""Codec, compaction, replay, scan and streaming on generated logs."""

import hashlib
import random
import zlib

import pytest

from palimpsest.operators import jobs
from palimpsest.sources import blocklog, imagefile, state
from palimpsest.sources.cbor import dumps, loads

B = 4096


def w(block, n, c):
    data = b"".join(bytes([ord(x)]) * B for x in (c if len(c) == n else c * n))
    return "W", block, n, data


def t(block, n):
    return "T", block, n, None


def write(folder, label, ops, device=1 << 20, bad=False):
    out = blocklog.encode_header(label, B, device, "/tmp/test.img")
    for i, (op, block, n, data) in enumerate(ops):
        out += blocklog.encode_entry(op, 100 + i, i, block, n * B, data, 0xDEADBEEF if bad else None)
    (folder / f"disk.{label}.log").write_bytes(out)


def image_of(folder):
    """A sequential fold of the log."""
    out = bytearray(1 << 20)
    for f in sorted(folder.glob("disk.*.log")):
        _, entries = blocklog.decode(f.read_bytes())
        for e in entries:
            out[e["block"] * B : e["block"] * B + e["length"]] = e["data"] if e["op"] == "W" else bytes(e["length"])
    return bytes(out)


CASES = [
    ("no shadow", {"aaa": [w(0, 1, "A")], "bbb": [w(10, 1, "B")]}, 50, {"aaa", "bbb"}, None),
    ("full shadow", {"aaa": [w(0, 1, "A")], "bbb": [w(0, 1, "B")]}, 50, {"bbb"}, None),
    ("partial", {"aaa": [w(0, 1, "A"), w(5, 1, "C")], "bbb": [w(0, 1, "B")]}, 60, {"bbb"}, [(5, 1, "W")]),
    ("trim shadows write", {"aaa": [w(0, 1, "A")], "bbb": [t(0, 1)]}, 50, {"bbb"}, None),
    ("trim only", {"aaa": [t(0, 10)]}, 50, {"aaa"}, None),
    ("at threshold", {"aaa": [w(0, 1, "A"), w(0, 1, "B")]}, 50, {"aaa"}, None),
    ("within segment", {"aaa": [w(0, 1, "A"), w(0, 1, "B")]}, 60, set(), [(0, 1, "W")]),
    ("cascade", {"aaa": [w(0, 1, "A"), w(1, 1, "B")], "bbb": [w(0, 1, "C")], "ccc": [w(0, 1, "D")]}, 50, {"aaa", "ccc"}, None),
    ("split write", {"aaa": [w(0, 8, "abcdefgh")], "bbb": [w(2, 4, "Z")]}, 60, {"bbb"}, [(0, 2, "W"), (6, 2, "W")]),
    ("split trim", {"aaa": [t(0, 4), w(10, 1, "X")], "bbb": [w(2, 1, "B"), w(10, 1, "Y")]}, 60, {"bbb"}, [(0, 2, "T"), (3, 1, "T")]),
]


@pytest.mark.parametrize("name,segments,threshold,kept,copied", CASES, ids=[c[0] for c in CASES])
def test_gc(spark, tmp_path, name, segments, threshold, kept, copied):
    for label, ops in segments.items():
        write(tmp_path, label, ops)
    before = image_of(tmp_path)
    result = jobs.gc(spark, str(tmp_path), threshold, timestamp_ns=7)
    left = set(blocklog.list_segments(spark, str(tmp_path)))
    assert left - {result.new_segment} == kept
    assert image_of(tmp_path) == before  # replay before equals replay after
    if copied is None:
        assert not result.new_segment
    else:
        _, entries = blocklog.decode((tmp_path / f"disk.{result.new_segment}.log").read_bytes())
        assert [(e["block"], e["length"] // B, e["op"]) for e in sorted(entries, key=lambda e: e["block"])] == copied
        assert [e["sequence"] for e in entries] == list(range(len(entries)))
        assert all(e["op"] == "T" or zlib.crc32(e["data"]) == e["checksum"] for e in entries)
    # a second run changes nothing
    again = jobs.gc(spark, str(tmp_path), threshold, timestamp_ns=7)
    assert image_of(tmp_path) == before and again.copied_entries <= result.copied_entries


def test_gc_dry_run_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.gc(spark, str(tmp_path))
    write(tmp_path, "aaa", [w(0, 1, "A")])
    write(tmp_path, "bbb", [w(0, 1, "B")])
    assert jobs.gc(spark, str(tmp_path), 50, dry_run=True).retired == ["aaa"]
    assert blocklog.list_segments(spark, str(tmp_path)) == ["aaa", "bbb"]


def test_random_log_replay_repack_and_checksum(spark, tmp_path):
    rng = random.Random(3)
    for label in ("4000000000000001", "4000000000000002", "4000000000000003"):
        write(tmp_path, label, [w(b, n, rng.choice("ABC")) if rng.random() < 0.7 else t(b, n) for b, n in ((rng.randrange(200), rng.randint(1, 30)) for _ in range(25))])
    want = image_of(tmp_path)
    out = tmp_path / "flat.img"
    counters = jobs.replay_flat(spark, str(tmp_path), str(out))
    assert out.read_bytes() == want and counters["entries"] == 75 and counters["crc_errors"] == 0
    assert jobs.log_checksum(spark, str(tmp_path)) == hashlib.sha256(want).hexdigest()
    packed = tmp_path / "packed"
    packed.mkdir()
    jobs.repack(spark, str(tmp_path), str(packed), "5000")
    assert image_of(packed) == want


def test_incremental_replay(spark, tmp_path):
    write(tmp_path, "aaa", [w(0, 2, "A")])
    out = tmp_path / "flat.img"
    jobs.replay_flat(spark, str(tmp_path), str(out), incremental=True)
    write(tmp_path, "bbb", [w(1, 1, "B"), t(5, 1)])
    got = jobs.replay_flat(spark, str(tmp_path), str(out), incremental=True)
    assert got["entries"] == 2 and out.read_bytes() == image_of(tmp_path)


def test_codec(spark, tmp_path):
    label = "4000000065b0a23c0bebc200"
    data = bytes(i % 251 for i in range(128 * 1024))
    raw = blocklog.encode_header(label, B, 10 << 20) + blocklog.encode_entry("W", 1, 0, 3, len(data), data) + blocklog.encode_entry("T", 2, 5, 10, 8192)
    extra = loads(raw)[0] | {99: {"a": [1, None, -3, True]}}
    raw = dumps(extra) + raw[len(dumps(loads(raw)[0])) :]
    header, entries = blocklog.decode(raw)
    assert header["segment_label"] == label and entries[0]["data"] == data and entries[1]["data"] is None and entries[1]["length"] == 8192
    assert len(blocklog.decode(raw[:-3], strict=False)[1]) == 1
    with pytest.raises(ValueError):
        blocklog.decode(raw[:-3])
    with pytest.raises(ValueError):
        blocklog.decode(b"")
    write(tmp_path, "x", [w(0, 1, "A")], bad=True)
    (tmp_path / "disk.y.log.tmp").write_bytes(raw)
    assert blocklog.read_log(spark, str(tmp_path)).count() == 1
    assert blocklog.read_log(spark, str(tmp_path), include_tmp=True).count() == 3
    assert blocklog.read_log(spark, str(tmp_path), include_tmp=True, after="x").count() == 2
    assert blocklog.read_log(spark, str(tmp_path), payload=False).first()["data"] is None
    assert blocklog.list_segments(spark, str(tmp_path)) == ["x"]


def test_image(spark, tmp_path):
    rng = random.Random(5)
    parts = {0: b"A" * 65536, 2: rng.randbytes(65536), 9000: b"tail"}
    path = str(tmp_path / "a.img")
    size = 9001 * 65536
    assert imagefile.write_image(path, [*sorted(parts.items()), (9002, bytes(10))], size) == (3, 1)
    got = {r["cluster"]: bytes(r["data"]) for r in imagefile.read_image(spark, path).collect()}
    assert got == {k: v.ljust(65536, b"\0") for k, v in parts.items()}
    assert imagefile.header_of(spark, path).virtual_size == size
    raw = bytearray(open(path, "rb").read())
    h = imagefile.Header.decode(raw)
    l2 = int.from_bytes(raw[h.l1_offset : h.l1_offset + 8], "big")
    raw[l2 + 20] ^= 1
    with pytest.raises(ValueError, match="CRC32C mismatch"):
        list(imagefile.clusters_of(bytes(raw)))


def test_scan(spark, tmp_path):
    run = 61440
    device = tmp_path / "dev"
    logs = tmp_path / "logs"
    logs.mkdir()
    content = bytearray(run * 7 + 4096)
    content[run : run + 5] = b"hello"
    device.write_bytes(content)
    scan = lambda label: jobs.scan_runs(spark, imagefile.read_runs(spark, str(device)), str(tmp_path / "hashes"), str(logs), label, len(content), 1)
    first = scan("aaa")
    assert first["total_runs"] == 8 and first["writes"] == 1 and first["trims"] == 2
    assert scan("bbb")["writes"] == 0 and blocklog.list_segments(spark, str(logs)) == ["aaa"]
    content[run : run + 5] = bytes(5)
    device.write_bytes(content)
    assert scan("ccc")["trims"] == 1
    _, entries = blocklog.decode((logs / "disk.ccc.log").read_bytes())
    assert [(e["op"], e["block"], e["length"]) for e in entries] == [("T", 15, run * 6 + 4096)]


def test_stream_ignores_order_and_redelivery(spark, tmp_path):
    from palimpsest.operators.overlay import apply
    from palimpsest.streaming import plane

    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, "bbb", [w(2, 4, "Z"), t(20, 2)])
    q = lambda: plane.maintain_live_map(spark, str(logs), str(tmp_path / "map"), str(tmp_path / "cp")).awaitTermination(120)
    q()
    write(logs, "aaa", [w(0, 8, "A"), w(20, 1, "B")])  # older, late
    q()
    rows = state.load(spark, str(tmp_path / "map"))
    got = lambda df: sorted((r["start"], r["blocks"], r["segment"], r["op"]) for r in df.collect())
    want = [(0, 2, "aaa", "W"), (2, 4, "bbb", "W"), (6, 2, "aaa", "W"), (20, 2, "bbb", "T")]
    assert got(rows) == want
    again = blocklog.versioned(blocklog.read_log(spark, str(logs), payload=False))
    assert got(apply(rows, again)) == want


def test_control_messages():
    from palimpsest.streaming import plane

    assert loads(plane.command("watch"))[0] == {1: "watch"}
    assert loads(plane.command("swap", path="/x"))[0] == {1: "swap", 3: "/x"}
    assert plane.event(dumps({1: "log_rotated", 2: 0, 3: "l", 4: "d", 5: 9, 6: 1}))["label"] == "l"
    assert plane.event(dumps({1: "block_miss", 2: 1, 3: 77})) == {"type": "block_miss", "dev_index": 1, "cluster_index": 77}
    assert [plane.answer(1, k) for k in (0, 2, 3)] == ["retry", "retry", "continue"] and plane.answer(0, 0) == "continue"


def test_labels(spark, tmp_path):
    assert state.get_label(spark, str(tmp_path / "l"), "k") == ""
    state.set_label(spark, str(tmp_path / "l"), "k", "1")
    state.set_label(spark, str(tmp_path / "l"), "k", "2")
    assert state.get_label(spark, str(tmp_path / "l"), "k") == "2"


# ---- scale paths and the daemon's jobs

def test_after_opens_no_older_file(spark, tmp_path):
    for label in ("a", "b", "c"):
        write(tmp_path, label, [w(0, 1, "A")])
    (tmp_path / "disk.a.log").chmod(0)
    (tmp_path / "disk.b.log").write_bytes(b"\xff")  # would fail if it were read
    assert [r["segment"] for r in blocklog.read_log(spark, str(tmp_path), after="b").collect()] == ["c"]
    assert blocklog.read_log(spark, str(tmp_path), after="c").count() == 0


def test_read_partly(spark, tmp_path):
    write(tmp_path, "a", [w(0, 1, "A"), w(1, 1, "B")])
    raw = (tmp_path / "disk.a.log").read_bytes()
    (tmp_path / "disk.b.log").write_bytes(raw[:-7])
    (tmp_path / "disk.c.log").write_bytes(b"")
    got = {r["segment"]: (r["entries"], r["error"]) for r in blocklog.read_partly(spark, str(tmp_path)).collect()}
    assert got["a"] == (2, None) and got["b"][0] == 1 and got["b"][1] and got["c"] == (0, "no header")
    with pytest.raises(ValueError, match="empty"):
        blocklog.read_log(spark, str(tmp_path))


def test_gc_writes_several_bounded_segments(spark, tmp_path):
    rng = random.Random(8)
    write(tmp_path, "a1", [w(b * 4, 1, rng.choice("ABC")) for b in range(60)])
    write(tmp_path, "a2", [w(b * 4, 1, "Z") for b in range(0, 60, 2)])
    before = image_of(tmp_path)
    result = jobs.gc(spark, str(tmp_path), 90, timestamp_ns=7, segment_bytes=16 * B)
    assert result.retired == ["a1"] and result.copied_entries == 30 and len(result.new_segments) == 4
    assert image_of(tmp_path) == before and result.new_segments == sorted(result.new_segments)
    sizes = [len(blocklog.decode((tmp_path / f"disk.{x}.log").read_bytes())[1]) for x in result.new_segments if (tmp_path / f"disk.{x}.log").exists()]
    assert sum(sizes) == 30 and max(sizes) <= 16
    again = jobs.live_map(spark, str(tmp_path))
    whole = jobs.live_map(spark, str(tmp_path), full=True)
    key = lambda df: sorted((r["start"], r["blocks"], r["segment"], r["version"]["entry_index"]) for r in df.collect())
    assert key(again) == key(whole)


def test_holes_are_not_read(spark, tmp_path):
    run = 61440
    path = tmp_path / "dev"
    with open(path, "wb") as f:
        f.truncate(run * 40 + 5)
        f.seek(run * 20)
        f.write(b"x" * 10)
    content = path.read_bytes()
    off = [(a, b) for a, b in imagefile.holes(str(path))]
    assert all(not any(content[a:b]) for a, b in off)
    if off:
        from palimpsest.operators.changes import in_hole

        asked = spark.createDataFrame([(i * run, min((i + 1) * run, len(content))) for i in range(41)], "lo long, hi long")
        inside = {r["lo"] // run for r in in_hole(asked, imagefile.read_holes(spark, str(path))).collect()}
        assert inside == {i for i in range(41) if any(a <= i * run and min((i + 1) * run, len(content)) <= b for a, b in off)} and 20 not in inside
    for r in imagefile.read_runs(spark, str(path)).collect():
        want = content[r["run_index"] * run : (r["run_index"] + 1) * run]
        assert (bytes(r["data"]), r["sha256"], r["is_zero"]) == (want, hashlib.sha256(want).hexdigest(), not any(want))


def test_rotation_restarts_with_each_segment(spark):
    from palimpsest.streaming.plane import rotate

    s = 1_000_000_000
    rows = [(1, 0, 0, 150), (1, 1, 1, 50), (1, 2, 2, 10), (1, 3, 3, 40), (1, 4, 4, 1), (1, 5, 70 * s, 1), (1, 6, 71 * s, 1), (2, 0, 5, 100), (2, 1, 6, 1)]
    df = spark.createDataFrame(rows, "dev_index int, sequence long, timestamp_ns long, bytes long").repartition(4)
    got = {(r["dev_index"], r["sequence"]): r["part"] for r in rotate(df, 100, 60).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 3, (1, 6): 3, (2, 0): 0, (2, 1): 1}


def test_misses_fill_the_base(spark, tmp_path):
    from palimpsest.streaming import plane

    logs, base, c = tmp_path / "logs", str(tmp_path / "base"), 16 * B
    logs.mkdir()
    write(logs, "a", [w(3, 2, "AB"), w(20, 1, "C"), t(4, 1), w(15, 2, "XY")])
    plane.swap_base(spark.createDataFrame([(0, bytes([7]) * c), (5, b"kept")], "cluster long, data binary"), base)
    events = spark.createDataFrame([(0, 0), (0, 1), (1, 9)], "dev_index int, cluster_index long")
    got = {(r["dev_index"], r["cluster_index"]): r["answer"] for r in plane.fill_misses(spark, events, str(logs), base).collect()}
    assert got == {(0, 0): "retry", (0, 1): "retry", (1, 9): "continue"}
    rows = {r["cluster"]: bytes(r["data"]) for r in state.load(spark, base).collect()}
    first = bytearray(bytes([7]) * c)
    first[3 * B : 4 * B], first[15 * B :] = b"A" * B, b"X" * B
    second = bytearray(c)
    second[:B], second[4 * B : 5 * B] = b"Y" * B, b"C" * B
    assert rows == {0: bytes(first), 1: bytes(second), 5: b"kept"}
    found = plane.resolve_misses(events, __import__("palimpsest.operators.overlay", fromlist=["x"]).write_extents(blocklog.versioned(blocklog.read_log(spark, str(logs)))), 16)
    assert {(r["cluster_index"], r["start"]) for r in found.collect()} == {(0, 3), (0, 15), (1, 16), (1, 20), (9, None)}
    # the same from a stream of events
    plane.swap_base(spark.createDataFrame([], "cluster long, data binary"), base)
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    plane.serve_misses(spark, stream, str(logs), base, str(tmp_path / "answers"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "answers")).where("answer = 'retry'").count() == 2
    assert {r["cluster"] for r in state.load(spark, base).collect()} == {0, 1}


def test_upload_and_limit(spark, tmp_path):
    from palimpsest.streaming import plane

    logs, store = tmp_path / "logs", tmp_path / "store"
    logs.mkdir()
    for label in ("0002", "0001"):
        write(logs, label, [w(0, 1, "A")])
    (logs / "disk.0003.log.tmp").write_bytes(b"x")
    assert jobs.upload(spark, str(logs), str(store), "p/", "v") == ["p/v/disk.0001.log", "p/v/disk.0002.log"]
    assert jobs.upload(spark, str(logs), str(store), "p/", "v") == []
    assert (store / "p/v/disk.0001.log").read_bytes() == (logs / "disk.0001.log").read_bytes()
    assert blocklog.list_segments(spark, str(store / "p/v")) == ["0001", "0002"]
    write(logs, "0004", [w(1, 1, "B")])
    for _ in range(2):
        plane.upload_stream(spark, str(logs), str(store), "", "w", str(tmp_path / "cp")).awaitTermination(120)
    assert blocklog.list_segments(spark, str(store / "w")) == ["0001", "0002", "0004"]
    size = jobs.folder_bytes(spark, str(logs))
    assert jobs.enforce_limit(spark, str(logs), size - 1, delete=False) == ["0001"] and jobs.enforce_limit(spark, str(logs), size) == []
    assert jobs.enforce_limit(spark, str(logs), size - 1) == ["0001"] and blocklog.list_segments(spark, str(logs)) == ["0002", "0004"]


def test_image_file_takes_writes_and_trims(spark, tmp_path):
    """Pieces into a new image, then into the same file; clusters of zeros go; the rest stays."""
    path, c = str(tmp_path / "a.img"), 65536
    rng = random.Random(4)
    want = bytearray(8 * c)
    for _ in range(2):
        rows = []
        at = 0
        while at < len(want) - c:
            n = rng.randint(1, 2 * c)
            data = rng.choice([None, rng.randbytes(n)])
            rows.append((at, n, data))
            want[at : at + n] = data or bytes(n)
            at += n + rng.randint(0, c)
        del want[8 * c :]
        rows = [(a, min(n, 8 * c - a), d and d[: 8 * c - a]) for a, n, d in rows if a < 8 * c]
        jobs.apply_to_image(spark, spark.createDataFrame(rows, "offset long, length long, data binary"), path, len(want))
        got = bytearray(8 * c)
        for r in imagefile.read_image(spark, path).collect():
            got[r["cluster"] * c : (r["cluster"] + 1) * c] = r["data"]
        assert got == want


def test_large_image_is_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imagefile, "CHUNK", 3)
    path = str(tmp_path / "a.img")
    parts = {i: bytes([i % 251 + 1]) * 4096 for i in (0, 1, 2, 3, 7, 508, 509, 510, 511, 1030)}
    imagefile.write_image(path, sorted(parts.items()), 1100 * 4096, 12)
    assert {r["cluster"]: bytes(r["data"]) for r in imagefile.read_image(spark, path).collect()} == parts


def test_command_line(spark, tmp_path, capsys):
    from palimpsest import cli

    logs, dev, flat, img, out = (tmp_path / x for x in ("logs", "dev", "flat", "a.img", "out"))
    logs.mkdir()
    content = bytearray(61440 * 3)
    content[61440:61445] = b"hello"
    dev.write_bytes(content)
    run = lambda *args: cli.main([str(a) for a in args], spark)
    run("scan", dev, logs)
    run("show", logs)
    run("show", logs, "--json", "--data")
    shown = capsys.readouterr().out
    assert "[WRITE]" in shown and '"op":"W"' in shown and b"hello".hex() in shown
    run("replay", logs, flat)
    run("replay", logs, img, "--image")
    run("extract", img, out)
    assert flat.read_bytes() == out.read_bytes() == bytes(content)
    run("sum", logs)
    run("sum", img)
    assert capsys.readouterr().out.count(hashlib.sha256(content).hexdigest()) == 2
    run("convert", flat, tmp_path / "b.img")
    run("compact", tmp_path / "b.img", tmp_path / "c.img")
    run("sum", tmp_path / "c.img")
    assert hashlib.sha256(content).hexdigest() in capsys.readouterr().out
    run("create", tmp_path / "d.img", "1.5M")
    assert imagefile.header_of(spark, str(tmp_path / "d.img")).virtual_size == 3 << 19
    packed = tmp_path / "packed"
    packed.mkdir()
    run("repack", logs, packed)
    assert len(blocklog.list_segments(spark, str(packed))) == 1
    run("gc", logs, "--dry-run")
    run("upload", logs, tmp_path / "store", "--volume", "v")
    run("limit", logs, "1G", "--dry-run")
    (tmp_path / "disk.toml").write_text(f'name = "v"\ndevice = "{dev}"\nbase_dir = "{logs}"\ninterval = 0\nlog_limit = "1"\n')
    content[0:1] = b"!"
    dev.write_bytes(content)
    run("up", tmp_path / "disk.toml", "--rounds", "2")
    assert "'writes': 1" in capsys.readouterr().out and blocklog.list_segments(spark, str(logs)) == []

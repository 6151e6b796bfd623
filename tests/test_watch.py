"""The rotation watch as a source, rotation as a stateful stream, and folds that follow a log."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import payload
from palimpsest.streaming import rotation, watch

from test_log import t, w, write

S = 1_000_000_000


def run(stream, out, checkpoint, **trigger):
    q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    return q


def test_watch_delivers_in_label_order_once(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    for i in (3, 1, 2):
        write(a, f"l{i}", [w(i, 1, "A")])
        time.sleep(0.02)
    write(b, "l2", [w(9, 1, "B")])
    (b / "disk.l9.log.tmp").write_bytes(b"")
    events = lambda: watch.watch(spark, {0: str(a), 7: str(b)}, 2)
    seen = []
    keep = lambda batch, n: seen.extend((n, r["label"], r["dev_index"]) for r in batch.collect())

    def go(rounds):
        q = events().writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        end = time.time() + 60
        while time.time() < end and len(seen) < rounds:
            time.sleep(0.2)
        time.sleep(1)
        q.stop()

    go(4)
    assert [x[1:] for x in seen] == [("l1", 0), ("l2", 0), ("l2", 7), ("l3", 0)]
    assert max(sum(n == m for m, _, _ in seen) for n, _, _ in seen) == 2  # batches of two
    # a restart goes on behind the offsets; what is repeated or late is no rotation, and devices have labels of their own
    write(a, "l0", [w(0, 1, "L")])
    write(a, "l2", [w(2, 1, "R")])
    write(b, "l3", [w(1, 1, "N")])
    write(a, "l4", [w(1, 1, "N")])
    go(6)
    assert [x[1:] for x in seen[4:]] == [("l3", 7), ("l4", 0)]
    rows = watch.history(spark, {0: str(a), 7: str(b)}).collect()
    assert sorted((r["label"], r["dev_index"]) for r in rows) == [("l0", 0), ("l1", 0), ("l2", 0), ("l2", 7), ("l3", 0), ("l3", 7), ("l4", 0)] and {r["type"] for r in rows} == {"log_rotated"}
    assert watch.history(spark, {}).count() == 0
    got = watch.entries(watch.history(spark, {7: str(b)}).where("bytes > 0")).collect()
    assert sorted((r["dev_index"], r["segment"], r["block"], r["op"]) for r in got) == [(7, "l2", 9, "W"), (7, "l3", 1, "W")]
    with pytest.raises(Exception, match="devices"):
        watch.register(spark)
        spark.read.format(watch.NAME).load().collect()


def fold(rows, size_limit, seconds):
    """Each device's rows in order, plainly; what is open at the end stays open."""
    out, open_, parts = [], {}, {}

    def close(dev, reason):
        if dev in open_:
            o = open_.pop(dev)
            out.append((dev, parts.get(dev, 0), reason, o[0], o[1], o[2], o[3]))
            parts[dev] = parts.get(dev, 0) + 1

    for dev, kind, seq, at, size in rows:
        if dev in open_ and at - open_[dev][4] >= seconds * S:
            close(dev, "age")
        if kind != "entry":
            close(dev, kind)
            if kind == "remove":
                parts.pop(dev, None)
            continue
        n, held, first, _, began = open_.get(dev, (0, 0, seq, seq, at))
        open_[dev] = (n + 1, held + size, first, seq, began)
        if held + size >= size_limit:
            close(dev, "size")
    return sorted(out), open_, parts


@pytest.mark.parametrize("seed", range(2))
def test_rotation_stream_equals_a_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, at, seq = [], 0, {}
    for _ in range(300):
        dev = rng.randrange(3)
        at += rng.choice([1, 5, 30, 900]) * S // 10
        kind = rng.choices(["entry", "flush", "remove"], [30, 2, 1])[0]
        if kind == "entry":
            seq[dev] = seq.get(dev, -1) + 1
        rows.append((dev, kind, seq.get(dev, 0), at, rng.randint(1, 40)))
        if kind == "remove":
            seq[dev] = -1
    source, out = tmp_path / "in", tmp_path / "out"
    # batch by batch, repeats among them
    schema = "dev_index int, kind string, sequence long, timestamp_ns long, bytes long"
    q = None
    for i in range(0, 300, 60):
        part = rows[i : i + 60]
        again = [r for r in part[-1:] if r[1] == "entry"]
        spark.createDataFrame(part + again, schema).coalesce(1).write.mode("append").parquet(str(source))
        if q is None:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = run(rotation.rotate_stream(stream, 200, 20, "0 seconds"), out, tmp_path / "cp")
        assert q.awaitTermination(180)
    got = sorted((r["dev_index"], r["part"], r["reason"], r["entries"], r["bytes"], r["first_sequence"], r["last_sequence"]) for r in spark.read.parquet(str(out)).collect())
    want, open_, parts = fold(rows, 200, 20)
    # timers close what is older than the newest entry
    timed = sorted((d, parts.get(d, 0), "age", *o[:4]) for d, o in open_.items() if o[4] + 20 * S <= at)
    assert got in (sorted(want + timed), want), (set(got) - set(want + timed), set(want + timed) - set(got))


def test_age_closes_without_another_entry(spark, tmp_path):
    schema = "dev_index int, kind string, sequence long, timestamp_ns long, bytes long"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "entry", 0, 1000 * S, 5), (2, "entry", 0, 1001 * S, 7)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    go = lambda: run(rotation.rotate_stream(stream, 100, 60, "0 seconds"), tmp_path / "out", tmp_path / "cp").awaitTermination(120)
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0
    # only another device moves the time on: device 1 is closed by its timer
    spark.createDataFrame([(2, "entry", 1, 1060 * S, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    spark.createDataFrame([(2, "flush", 1, 1060 * S + S // 2, 0)], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    rows = {(r["dev_index"], r["part"]): (r["reason"], r["entries"], r["bytes"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(1, 0): ("age", 1, 5), (2, 0): ("flush", 2, 8)}


def test_a_followed_log_equals_the_whole(spark, tmp_path):
    from palimpsest.operators.livestore import LiveMap

    logs, path = tmp_path / "logs", str(tmp_path / "map")
    logs.mkdir()
    rng = random.Random(2)
    live = LiveMap(spark, path, 64)
    for turn in range(2):
        for i in range(3):
            write(logs, f"l{turn}{i}", [w(b, n, rng.choice("ABC")) if rng.random() < 0.7 else t(b, n) for b, n in ((rng.randrange(200), rng.randint(1, 30)) for _ in range(10))])
        if turn:  # earlier segments are not opened again
            kept = {f: (logs / f).read_bytes() for f in os.listdir(logs) if f.startswith("disk.l0")}
            for f in kept:
                (logs / f).write_bytes(b"")
        watch.drain(watch.follow(spark, str(logs), path, str(tmp_path / "cp"), 2, 64, processingTime="0 seconds"))
    for f, raw in kept.items():
        (logs / f).write_bytes(raw)
    key = lambda df: sorted((r["start"], r["blocks"], r["segment"], r["version"]["entry_index"], r["op"]) for r in df.collect())
    assert key(live.extents()) == key(payload.live_ranges(payload.index(spark, str(logs)))) and live.label() == "l12"


def test_misses_keep_their_tries(spark, tmp_path):
    from palimpsest.operators import jobs
    from palimpsest.operators.clusterstore import ClusterStore
    from palimpsest.streaming import misses

    from test_log import B

    logs, c = tmp_path / "logs", 16 * B
    logs.mkdir()
    write(logs, "a", [w(3, 2, "AB"), w(20, 1, "C"), t(4, 1), w(15, 2, "XY")])
    write(logs, "b", [w(900, 1, "Q")])
    base = ClusterStore(spark, str(tmp_path / "base"), zone_clusters=2)
    base.replace(spark.createDataFrame([(0, bytes([7]) * c), (5, b"kept"), (40, b"far")], "cluster long, data binary"))
    source, schema = str(tmp_path / "in"), "dev_index int, cluster_index long"
    os.mkdir(source)
    stream = spark.readStream.schema(schema).parquet(source)
    got = []

    def ask(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        assert misses.serve(spark, stream, str(logs), str(tmp_path / "base"), str(tmp_path / "answers"), str(tmp_path / "cp"), zone_clusters=2, forget=3600).awaitTermination(180)
        new = sorted((r["dev_index"], r["cluster_index"], r["tries"], r["answer"]) for r in spark.read.parquet(str(tmp_path / "answers")).collect())
        out = list(new)
        for r in got:
            out.remove(r)
        got.extend(out)
        return out

    assert ask((0, 0), (0, 1), (1, 9)) == [(0, 0, 0, "retry"), (0, 1, 0, "retry"), (1, 9, 0, "continue")]
    first, second = bytearray(bytes([7]) * c), bytearray(c)
    first[3 * B : 4 * B], first[15 * B :] = b"A" * B, b"X" * B
    second[:B], second[4 * B : 5 * B] = b"Y" * B, b"C" * B
    held = lambda: {r["cluster"]: bytes(r["data"]) for r in base.clusters().collect()}
    assert held() == {0: bytes(first), 1: bytes(second), 5: b"kept", 40: b"far"}
    # neither another segment's payload nor another zone of the base is needed
    (logs / "disk.b.log").write_bytes((logs / "disk.b.log").read_bytes()[:60])
    for zone, folder, _ in base.zones.manifest():
        if zone == 20:
            for f in os.listdir(f"{folder}/zone=20"):
                os.truncate(f"{folder}/zone=20/{f}", 1)
    # the fourth in a row reads zeros, then they begin again
    assert ask((0, 0), (0, 0), (0, 0), (0, 0), (0, 1)) == [(0, 0, 0, "retry"), (0, 0, 1, "retry"), (0, 0, 2, "retry"), (0, 0, 3, "continue"), (0, 1, 1, "retry")]
    base.replace(spark.createDataFrame([(1, bytes([9]) * c)], "cluster long, data binary"))  # swapped under the stream
    ask((0, 1))
    third = bytearray(bytes([9]) * c)
    third[:B], third[4 * B : 5 * B] = b"Y" * B, b"C" * B
    assert held() == {1: bytes(third)}


def test_a_base_is_compacted(spark, tmp_path):
    from palimpsest.operators.clusterstore import ClusterStore

    base = ClusterStore(spark, str(tmp_path), zone_clusters=4)
    want = {}
    for i in range(11):
        rows = {i % 4: bytes([i]), 9: bytes([i, i])} if i % 5 == 0 else {i % 4: bytes([i])}
        base.upsert(spark.createDataFrame(list(rows.items()), "cluster long, data binary"))
        want |= rows
    assert {r["cluster"]: bytes(r["data"]) for r in base.clusters().collect()} == want
    assert sum(z == 0 for z, _, _ in base.zones.manifest()) < 9
    assert {r["cluster"] for r in base.of(spark.createDataFrame([(9,), (2,), (77,)], "cluster long")).collect()} == {2, 9}
    assert ClusterStore(spark, str(tmp_path / "none")).clusters().count() == 0


def test_a_disk_runs(spark, tmp_path):
    """Rotations fold and upload; a collection afterwards goes on from the same map."""
    from palimpsest.operators import jobs, upload
    from palimpsest.sources import blocklog
    from palimpsest.streaming import daemon

    from test_log import image_of

    logs, store = tmp_path / "logs", tmp_path / "store"
    logs.mkdir(), store.mkdir()
    write(logs, "a1", [w(0, 8, "A"), t(20, 4)])
    write(logs, "a2", [w(0, 6, "B")])
    q, = daemon.run(spark, str(logs), str(tmp_path / "cp"), str(store), "p/", "v", segments_per_batch=1, processingTime="0 seconds")
    try:
        q.processAllAvailable()
        write(logs, "a3", [w(30, 1, "C")])
        q.processAllAvailable()
    finally:
        q.stop()
    assert blocklog.list_segments(spark, str(store / "p" / "v")) == ["a1", "a2", "a3"] and upload.manifest(spark, str(store), "p/", "v").count() == 3
    assert jobs.stored_map(spark, str(logs)).label() == "a3"
    before = image_of(logs)
    result = jobs.gc(spark, str(logs), 60)
    assert result.retired == ["a1"] and image_of(logs) == before

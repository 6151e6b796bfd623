"""Overlay, intervals, images and scalar functions against sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import labels as L
from palimpsest.functions.checks import crc32c, crc32c_col, lz4_compress, lz4_decompress
from palimpsest.operators import changes, image, intervals, overlay
from palimpsest.queries import _written_image


def fold(ops):
    owner = {}
    for v, op, b, n in ops:
        for x in range(b, b + n):
            owner[x] = v
    out, kind = [], {v: op for v, op, _, _ in ops}
    for x in sorted(owner):
        if out and out[-1][0] + out[-1][1] == x and out[-1][2] == owner[x]:
            out[-1][1] += 1
        else:
            out.append([x, 1, owner[x]])
    return sorted((a, n, v, kind[v]) for a, n, v in out)


@pytest.mark.parametrize("seed", range(3))
def test_overlay_plans_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    ops = [(v, rng.choice("WWT"), rng.randrange(1500), rng.randint(1, 700 if v % 9 == 0 else 12)) for v in range(120)]
    df = spark.createDataFrame([(v, op, b, n, 1) for v, op, b, n in ops] + [(999, "X", 0, 2000, 1)], "version long, op string, block long, blocks long, segment int")
    for plan in ("explode", "buckets"):
        got = sorted((r["start"], r["blocks"], r["version"], r["op"]) for r in overlay.live_extents(df, plan).collect())
        assert got == fold(ops)


@pytest.mark.parametrize("seed", range(2))
def test_folds_in_any_order_equal_one_fold(spark, seed):
    """Only buckets of the new entries are folded; the rest of the state passes by."""
    rng = random.Random(seed)
    ops = [(v, rng.choice("WWT"), rng.randrange(4000), rng.randint(1, 900 if v % 9 == 0 else 12)) for v in range(90)]
    df = spark.createDataFrame([(v, op, b, n, v % 5) for v, op, b, n in ops], "version long, op string, block long, blocks long, segment int")
    state = spark.createDataFrame([], "version long, segment int, op string, start long, blocks long")
    for part in rng.sample(range(5), 5) + [1]:
        state = spark.createDataFrame(overlay.apply(state, df.where(F.col("segment") == part)).collect(), state.schema)
    assert sorted((r["start"], r["blocks"], r["version"], r["op"]) for r in state.collect()) == fold(ops)


def test_a_wide_trim_and_a_hot_block(spark):
    """A 4 GiB trim costs rows a bucket, not blocks; a block written a million times, one row."""
    wide = 1 << 20
    hot = spark.range(1_000_000).select((F.col("id") + 10).alias("version"), F.lit("W").alias("op"), (F.lit(70_000) + F.col("id") % 3).alias("block"), (F.lit(1) + F.col("id") % 2).alias("blocks"))
    rest = spark.createDataFrame([(1, "W", 5, 300), (2, "T", 0, wide), (3, "W", 100, 1), (4, "T", 512, 256)], "version long, op string, block long, blocks long")
    log = rest.union(hot)
    got = sorted((r["start"], r["blocks"], r["version"], r["op"]) for r in overlay.live_extents(log).collect())
    newest = {}
    for i in range(999_990, 1_000_000):
        for x in range(1 + i % 2):
            newest[70_000 + i % 3 + x] = i + 10
    want = [(0, 100, 2, "T"), (100, 1, 3, "W"), (101, 411, 2, "T"), (512, 256, 4, "T"), (768, 70_000 - 768, 2, "T"), (70_004, wide - 70_004, 2, "T")]
    want += [(a, n, v, "W") for a, n, v, _ in fold([(v, "W", b, 1) for b, v in sorted(newest.items(), key=lambda x: x[1])])]
    assert got == sorted(want)


def test_reattribution_merges(spark):
    ext = spark.createDataFrame([(0, 2, "a", "W"), (2, 3, "b", "W"), (5, 1, "b", "T"), (6, 1, "a", "W")], "start long, blocks long, segment string, op string")
    got = sorted((r["start"], r["blocks"], r["segment"], r["op"]) for r in overlay.reattribute_segment(ext, "a", "b").collect())
    assert got == [(0, 5, "b", "W"), (5, 1, "b", "T"), (6, 1, "b", "W")]


@pytest.mark.parametrize("pairs,want", [([(10, 20), (30, 40)], [(10, 20), (30, 40)]), ([(10, 20), (15, 30)], [(10, 30)]), ([(10, 20), (20, 30)], [(10, 30)]), ([(0, 10), (20, 30), (40, 50), (5, 45)], [(0, 50)]), ([(0, 5000), (5000, 5001), (9000, 9000)], [(0, 5001)])])
def test_coalesce(spark, pairs, want):
    df = spark.createDataFrame(pairs, "lo long, hi long")
    assert sorted(map(tuple, intervals.coalesce(df).collect())) == want
    assert sorted(map(tuple, intervals.coalesce(df, span=9000).collect())) == want
    assert sorted(map(tuple, intervals.coalesce(df, width=2, span=9000).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_intervals(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, a + rng.randint(1, 300)) for a in (rng.randrange(9000) for _ in range(60))]
    df = spark.createDataFrame(pairs, "lo long, hi long")
    on = {x for a, b in pairs for x in range(a, b)}
    off = {x for a, b in map(tuple, intervals.gaps(df, 100, 9100).collect()) for x in range(a, b)}
    assert off == set(range(100, 9100)) - on
    asked = [(i, a, a + 1 + rng.randrange(200)) for i, a in enumerate(rng.randrange(9000) for _ in range(50))]
    q = spark.createDataFrame(asked, "q_id long, q_lo long, q_hi long")
    got = {r["q_id"]: r["covered"] for r in intervals.covers(df, q).collect()}
    assert got == {i: all(x in on for x in range(a, b)) for i, a, b in asked}


def test_gaps_of_nothing_and_empty(spark):
    none = spark.createDataFrame([], "lo long, hi long")
    assert list(map(tuple, intervals.gaps(none, 0, 5000).collect())) == [(0, 5000)]
    assert intervals.coalesce(none).count() == 0


def test_lookup_clips(spark):
    ext = spark.createDataFrame([(0, 5000, "A")], "start long, blocks long, ref string")
    q = spark.createDataFrame([(3, 7), (1000, 4000), (6000, 6001)], "q_lo long, q_hi long")
    assert sorted((r["start"], r["blocks"]) for r in intervals.lookup(ext, q).collect()) == [(3, 4), (1000, 3000)]


@pytest.mark.parametrize("seed", range(4))
def test_trim_islands_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(i, 100, "z" if rng.random() < 0.6 else f"d{i}", rng.random() < 0.5) for i in range(60)]
    want, start, n = [], None, 0
    for i, _, h, same in rows:
        if h == "z":
            if start is None and not same:
                start, n = i, 0
            n += start is not None
        elif start is not None:
            want.append((start, n))
            start = None
    if start is not None:
        want.append((start, n))
    df = spark.createDataFrame([(i, b, h, h if same else None) for i, b, h, same in rows], "run_index long, run_bytes long, sha256 string, prev_sha256 string")
    got = changes.trim_islands(changes.classify(df, F.lit("z")), width=7)
    assert sorted((r["start_run"], r["runs"]) for r in got.collect()) == want


def test_trim_of_one_stretch_across_buckets(spark):
    """A device of zeros with one changed run is one trim from there on, joined over buckets and levels."""
    n, width = 9000, 4
    df = spark.range(n).select(F.col("id").alias("run_index"), F.lit(10).cast("long").alias("run_bytes"), F.lit("z").alias("sha256"), F.when(~F.col("id").isin(4999, 5003), F.lit("z")).alias("prev_sha256"))
    assert [tuple(r) for r in changes.trim_islands(changes.classify(df, F.lit("z")), width=width).collect()] == [(4999, n - 4999, 10 * (n - 4999))]


def test_trim_chunks_stay_aligned(spark):
    df = spark.createDataFrame([(1, 3, 10 << 32)], "start_run long, runs long, bytes long")
    rows = sorted(map(tuple, changes.trim_chunks(df).collect()))
    assert sum(n for _, n in rows) == 10 << 32
    assert all(b == 15 + sum(n for _, n in rows[:i]) // 4096 and n < 1 << 32 for i, (b, n) in enumerate(rows))


def test_layers_and_pieces(spark):
    base = spark.createDataFrame([(0, b"bbbb"), (1, b"bbbb"), (3, b"bbbb")], "cluster long, data binary")
    pieces = spark.createDataFrame([(2, 4, b"WXYZ"), (12, 4, None)], "offset long, length long, data binary")
    made = {r["cluster"]: r["data"] and bytes(r["data"]) for r in image.from_pieces(pieces, base, 4).collect()}
    assert made == {0: b"bbWX", 1: b"YZbb", 3: None}
    primary = spark.createDataFrame([(0, b"pppp"), (3, None)], "cluster long, data binary")
    got = {r["cluster"]: (r["source"], bytes(r["data"])) for r in image.layered(primary, base, 4).collect()}
    assert got == {0: ("primary", b"pppp"), 1: ("base", b"bbbb"), 3: ("trimmed", bytes(4))}


def test_no_task_holds_more_of_a_larger_image(spark, tmp_path, monkeypatch):
    """Partitions follow the bytes of the texts, not the session's setting."""
    monkeypatch.setattr(image, "PART_BYTES", 1 << 14)
    for n in (200, 800):
        spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é1"), 200 + (F.col("id") % 7).cast("int")).alias("text")).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        made = _written_image(spark, f"{tmp_path}/{n}")
        held = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.sum(F.coalesce(F.length("data"), F.lit(0))).alias("n")).collect()]
        assert sum(held) > n * 600 and max(held) < 3 << 14


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert crc32c(b"123456789") == 0xE3069283
    rows = spark.createDataFrame([(b"123456789",), (b"",), (None,)], "b binary")
    assert [r[0] for r in rows.select(crc32c_col("b")).collect()] == [0xE3069283, 0, None]
    assert one(lz4_decompress(lz4_compress(F.lit(b"a" * 9999)), F.lit(9999))) == b"a" * 9999
    assert one(L.tai64n(F.lit(1706074684), F.lit(200000000))) == L.label_of(1706074684, 200000000)
    assert one(L.tai64n_seconds(F.lit(L.label_of(1706074684, 5)))) == 1706074684
    assert [one(L.parse_size(F.lit(s))) for s in ("100M", "1.5 GB", "512k", "7", "x", "-1")] == [100 << 20, 3 << 29, 512 << 10, 7, None, None]
    assert [one(L.parse_size_c(F.lit(s))) for s in ("0x10K", "2T", "010", "5junk")] == [16 << 10, 2 << 40, 8, 5]
    assert one(L.utc_nanos(F.lit(1700000000000000007))) == "2023-11-14 22:13:20.000000007"
    assert one(L.label_from_path(F.lit("/a/disk.4000.log"))) == "4000"
    assert one(L.log_key("p/", "v", F.lit("7"))) == "p/v/disk.7.log"
    assert one(image.is_zero(F.lit(bytes(9)))) and not one(image.is_zero(F.lit(b"\0\1")))


def test_times_keep_their_second(spark):
    """The last nanoseconds of a second, where doubles round up to the next, and times before 1970."""
    made = [(1_700_000_000_999_999_999, "2023-11-14 22:13:20.999999999"), (1_706_659_199_999_999_900, "2024-01-30 23:59:59.999999900"), (-1, "1969-12-31 23:59:59.999999999"), (-1_000_000_000, "1969-12-31 23:59:59.000000000"), (0, "1970-01-01 00:00:00.000000000")]
    rows = spark.createDataFrame(made, "ns long, want string").select(L.utc_nanos(F.col("ns")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]

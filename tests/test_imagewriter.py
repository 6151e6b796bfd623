"""Image files written by many tasks, and CRC-32C in strides."""

import os
import random

import pytest

from palimpsest.functions.checks import crc32c, crc32c_many
from palimpsest.sources import imagefile, imagewriter

C = 4096


def bitwise(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c_in_strides():
    rng = random.Random(1)
    values = [b"", b"a", b"123456789", *(rng.randbytes(n) for n in (255, 256, 257, 511, 512, 513, 5000)), bytes(1024), b"\xff" * 700]
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c_many(values).tolist() == [bitwise(v) for v in values] and crc32c_many([]).tolist() == []


def held(spark, path):
    return {r["cluster"]: bytes(r["data"]) for r in imagefile.read_image(spark, path).collect()}


@pytest.fixture
def parts():
    rng = random.Random(7)
    made = {i: rng.choice([rng.randbytes(C), bytes([i % 251 + 1]) * C, b"short" * 3]) for i in rng.sample(range(1600), 120)}
    return made | {510: b"x" * C, 511: b"y", 1021: rng.randbytes(C), 1022: b"z" * C}


def test_many_tasks_write_one_image(spark, tmp_path, parts, monkeypatch):
    monkeypatch.setattr(imagewriter, "CELL", 16)
    path = str(tmp_path / "a.img")
    rows = [*parts.items(), (3000, bytes(C)), (3001, None), (3002, b"")]
    df = spark.createDataFrame(rows, "cluster long, data binary").repartition(9)
    seen = imagewriter.write_clusters(df, path, 4000 * C, 12)
    want = {i: d.ljust(C, b"\0") for i, d in parts.items()}
    assert held(spark, path) == want and os.listdir(tmp_path) == ["a.img"]
    assert seen["clusters"] == len(rows) and seen["written"] == len(parts) and seen["zero"] == 3 and 0 < seen["packed"] < len(parts)
    # no two clusters share a place, and all lie before the tables
    raw = open(path, "rb").read()
    header = imagefile.Header.decode(raw)
    spots = sorted((at, packed) for _, at, packed, _ in imagefile.clusters_of(raw))
    assert len({at for at, _ in spots}) == len(parts) and all(at % C == 0 for at, _ in spots) and len(raw) == header.alloc_offset and header.virtual_size == 4000 * C
    assert seen["stored_bytes"] <= len(raw) and {i: d for i, _, _, d in imagefile.clusters_of(raw)} == want
    # the same by one writer
    imagefile.write_image(str(tmp_path / "b.img"), sorted(parts.items()), 4000 * C, 12)
    assert held(spark, str(tmp_path / "b.img")) == want


def test_compaction_in_place_drops_dead_space(spark, tmp_path, parts):
    path = str(tmp_path / "a.img")
    imagefile.write_image(path, sorted(parts.items()), 2000 * C, 12)
    with open(path, "ab") as f:
        f.write(b"dead" * 100_000)
    before = held(spark, path)
    seen = imagewriter.compact(spark, path, path)
    assert held(spark, path) == before and seen["written"] == len(parts) and os.path.getsize(path) < 200 * C + (len(parts) + 8) * C


def test_a_sparse_file_is_converted(spark, tmp_path):
    source, path = tmp_path / "flat", str(tmp_path / "a.img")
    with open(source, "wb") as f:
        f.truncate(3000 * C + 5)
        for at, data in ((0, b"a"), (700 * C - 3, b"bcdefg"), (3000 * C, b"tail!")):
            f.seek(at)
            f.write(data)
    seen = imagewriter.convert(spark, str(source), path, 12)
    content = source.read_bytes()
    want = {i: content[i * C : (i + 1) * C].ljust(C, b"\0") for i in range(3001) if any(content[i * C : (i + 1) * C])}
    assert held(spark, path) == want and seen["written"] == 4 and imagefile.header_of(spark, path).virtual_size == 3000 * C + 5
    (tmp_path / "none").write_bytes(b"")
    assert imagewriter.convert(spark, str(tmp_path / "none"), str(tmp_path / "b.img"))["clusters"] == 0 and held(spark, str(tmp_path / "b.img")) == {}


def test_bad_images_are_refused_and_leave_the_old_one(spark, tmp_path):
    path = tmp_path / "a.img"
    path.write_bytes(b"old")
    for rows, says in (([(1, b"x" * (C + 1))], "a cluster of"), ([(5, b"x"), (5, b"y")], "twice"), ([(9999, b"x")], "beyond")):
        with pytest.raises(Exception, match=says):
            imagewriter.write_clusters(spark.createDataFrame(rows, "cluster long, data binary"), str(path), 100 * C, 12)
    assert path.read_bytes() == b"old" and os.listdir(tmp_path) == ["a.img"]

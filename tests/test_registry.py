"""Every registered query with SQL equals DuckDB on the smallest tables."""

import hashlib
import os
import zlib

import duckdb
import pytest

from palimpsest.functions.checks import crc32c
from palimpsest.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_payload_crc32(spark):
    """Checksums in SQL are too slow on whole texts; the library's are the measure here."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["payload_crc32"](spark, SF).collect()
    assert len(rows) == len(texts) and all(r["valid"] and r["checksum"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_payload_crc32c_and_image_writes(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["checksum"] for r in QUERIES["payload_crc32c"](spark, SF).collect()}
    assert got == {i: crc32c(t) for i, t in texts.items()}
    total = sum(len(t) + 7 for t in texts.values())
    content = bytearray(b"a" * (total // 512 * 256)).ljust(-(-total // 256) * 256, b"\0")
    at = 0
    for _, t in sorted(texts.items()):  # whole texts, seven bytes apart
        content[at : at + len(t)] = t
        at += len(t) + 7
    rows = {r["cluster"]: r["data_sha256"] for r in QUERIES["image_writes"](spark, SF).collect()}
    for c in range(len(content) // 256):
        part = bytes(content[c * 256 : (c + 1) * 256])
        assert rows.get(c) == (hashlib.sha256(part).hexdigest() if any(part) else None), c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_payload_slice_takes_every_document(spark, tmp_path):
    """Bytes, not characters, of accented, short, empty and null texts too."""
    made = [(-1, "é☃" * 40), (-2, "kurz"), (-3, ""), (-4, None), (-5, "x" * 16 + "é"), (-6, "a" * 15 + "é" * 60)]
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = {r["doc_id"]: r["part_sha256"] for r in QUERIES["payload_slice_bytes"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.sha256(t.encode()[16:80]).hexdigest() for i, t in texts.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    cursor = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    assert sorted(got.columns) == columns
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str([r[c] for c in columns]) for r in want)

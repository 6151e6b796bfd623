"""Uploads by many tasks, with a manifest."""

import os
import zlib

from palimpsest.operators import upload

from test_log import w, write


def test_uploads_and_retries_alone(spark, tmp_path):
    logs, store = tmp_path / "logs", tmp_path / "store"
    logs.mkdir(), store.mkdir()
    for i in range(6):
        write(logs, f"{i:04d}", [w(i, 1, "ABCDEF"[i])])
    (logs / "disk.0009.log.tmp").write_bytes(b"x")
    blocked = store / "p" / "v" / "disk.0003.log" / "in the way"
    blocked.mkdir(parents=True)
    go = lambda **k: {r["label"]: r for r in upload.upload(spark, str(logs), str(store), "p/", "v", **k).collect()}
    first = go()
    assert set(first) == {f"{i:04d}" for i in range(6)} and [x for x, r in first.items() if r["error"]] == ["0003"]
    for i in (0, 1, 2, 4, 5):
        raw = (logs / f"disk.{i:04d}.log").read_bytes()
        assert (store / "p" / "v" / f"disk.{i:04d}.log").read_bytes() == raw and first[f"{i:04d}"]["crc32"] == zlib.crc32(raw) and first[f"{i:04d}"]["bytes"] == len(raw)
    assert not [f for f in os.listdir(store / "p" / "v") if "part" in f]
    times = {f: os.stat(store / "p" / "v" / f).st_mtime_ns for f in os.listdir(store / "p" / "v") if f.endswith(".log") and "0003" not in f}
    blocked.rmdir(), blocked.parent.rmdir()
    again = go()
    assert set(again) == {"0003"} and again["0003"]["error"] is None and go() == {}
    assert times == {f: os.stat(store / "p" / "v" / f).st_mtime_ns for f in times}
    assert upload.manifest(spark, str(store), "p/", "v").count() == 6
    write(logs, "0007", [w(1, 1, "Z")])
    write(logs, "0008", [w(1, 1, "Z")])
    assert set(go(labels=["0008", "none"])) == {"0008"} and set(go()) == {"0007"}
    (tmp_path / "none").mkdir()
    assert upload.upload(spark, str(tmp_path / "none"), str(store), "p/", "v").count() == 0

"""Command line: show, replay, repack, scan, gc, sum, create, convert, extract, compact, upload, limit, up."""

from __future__ import annotations

import argparse
import os
import time
import tomllib

from pyspark.sql import SparkSession, functions as F

from palimpsest.functions.labels import label_of, parse_size
from palimpsest.operators import image, jobs, replay
from palimpsest.operators.show import as_json, described
from palimpsest.sources import blocklog, imagefile, imagewriter


def now_label() -> str:
    ns = time.time_ns()
    return label_of(ns // 1_000_000_000, ns % 1_000_000_000)


def config(path: str) -> dict:
    """Options of a disk from a TOML file."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    show = sub.add_parser("show", help="print the entries of a log folder")
    show.add_argument("folder")
    show.add_argument("--json", action="store_true")
    show.add_argument("--data", action="store_true")
    r = sub.add_parser("replay", help="replay a log into a flat file or an image")
    r.add_argument("folder")
    r.add_argument("out")
    r.add_argument("--image", action="store_true")
    r.add_argument("--incremental", action="store_true")
    r = sub.add_parser("repack", help="rewrite all live ranges as one segment")
    r.add_argument("folder")
    r.add_argument("out")
    g = sub.add_parser("gc", help="retire segments of low utilization")
    g.add_argument("folder")
    g.add_argument("--threshold", type=float, default=50.0)
    g.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("scan", help="log what changed in a device file")
    s.add_argument("device")
    s.add_argument("folder")
    s = sub.add_parser("sum", help="checksum of a log's or an image's content")
    s.add_argument("path")
    for name in ("convert", "extract", "compact"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("out")
    c = sub.add_parser("create", help="make an empty image")
    c.add_argument("out")
    c.add_argument("size")
    c = sub.add_parser("upload", help="copy a folder's segments to a store")
    c.add_argument("folder")
    c.add_argument("store")
    c.add_argument("--prefix", default="")
    c.add_argument("--volume", default="disk")
    c = sub.add_parser("limit", help="delete the oldest segments beyond a size")
    c.add_argument("folder")
    c.add_argument("size")
    c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("up", help="scan the device of a disk file's options again and again")
    c.add_argument("config")
    c.add_argument("--rounds", type=int)
    return p


def bytes_of(spark: SparkSession, text: str) -> int:
    n = spark.range(1).select(parse_size(F.lit(text)).alias("n")).first()["n"]
    if n is None:
        raise ValueError(f"not a size: {text}")
    return n


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "show":
        log = blocklog.read_log(spark, a.folder, strict=False)
        rows = described(log, F.col("block_size")).orderBy("segment", "entry_index")
        for r in as_json(rows, a.data).toLocalIterator() if a.json else rows.toLocalIterator():
            print(r["json"] if a.json else f"{r['segment']} #{r['sequence']} [{r['kind']}] {r['time']} UTC blocks {r['block']}-{r['block_end']} {r['size']}")
        print(f"Total entries: {log.count()}")
    elif a.command == "replay":
        if a.image:
            print(jobs.replay_image(spark, a.folder, a.out))
        else:
            print(jobs.replay_flat(spark, a.folder, a.out, a.incremental))
    elif a.command == "repack":
        print(jobs.repack(spark, a.folder, a.out, now_label()))
    elif a.command == "gc":
        result = jobs.gc(spark, a.folder, a.threshold, a.dry_run)
        for r in result.stats:
            print(f"{r['segment']} {r['live_write_bytes']}/{r['total_write_bytes']} {100 * r['utilization']:.1f}%{' retired' if r['segment'] in result.retired else ''}")
        print(f"copied {result.copied_entries} entries, {result.copied_bytes} bytes; deleted {result.deleted}")
    elif a.command == "create":
        imagefile.create_image(a.out, bytes_of(spark, a.size))
    elif a.command == "upload":
        print(jobs.upload(spark, a.folder, a.store, a.prefix, a.volume))
    elif a.command == "limit":
        print(jobs.enforce_limit(spark, a.folder, bytes_of(spark, a.size), not a.dry_run))
    elif a.command == "up":
        disk = config(a.config)
        for counters in jobs.scan_every(spark, disk["device"], disk["base_dir"], disk.get("interval", 60), a.rounds):
            print(counters)
        if disk.get("log_limit"):
            print(jobs.enforce_limit(spark, disk["base_dir"], bytes_of(spark, str(disk["log_limit"]))))
        if disk.get("store"):
            print(jobs.upload(spark, disk["base_dir"], disk["store"], disk.get("prefix", ""), disk["name"]))
    elif a.command == "scan":
        runs = imagefile.read_runs(spark, os.path.abspath(a.device))
        print(jobs.scan_runs(spark, runs, f"{a.folder}/.hashes", a.folder, now_label(), os.path.getsize(a.device), time.time_ns()))
    elif a.command == "sum":
        if os.path.isdir(a.path):
            print(jobs.log_checksum(spark, a.path))
        else:
            h = imagefile.header_of(spark, a.path)
            print(replay.checksum(image.to_pieces(imagefile.read_image(spark, a.path), h.cluster).withColumnRenamed("offset", "start").repartition(1).sortWithinPartitions("start"), 1, h.virtual_size))
    elif a.command == "convert":
        print(imagewriter.convert(spark, a.source, a.out))
    else:
        h = imagefile.header_of(spark, a.source)
        rows = imagefile.read_image(spark, a.source)
        if a.command == "extract":
            print(replay.write_flat(image.to_pieces(rows, h.cluster), a.out, h.virtual_size))
        else:
            print(imagewriter.compact(spark, a.source, a.out))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

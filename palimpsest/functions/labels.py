"""Segment labels (TAI64N), sizes, times: scalar functions as columns, and their plain forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TAI_BASE = 1 << 62


def label_of(seconds: int, nanos: int) -> str:
    return f"{seconds + TAI_BASE:016x}{nanos:08x}"


def split_label(label: str) -> tuple[int, int]:
    return int(label[:16], 16) - TAI_BASE, int(label[16:24], 16)


def tai64n(seconds: Column, nanos: Column) -> Column:
    return F.format_string("%016x%08x", seconds.cast("long") + F.lit(TAI_BASE), nanos.cast("long"))


def tai64n_seconds(label: Column) -> Column:
    return F.conv(F.substring(label, 1, 16), 16, 10).cast("decimal(20,0)").cast("long") - F.lit(TAI_BASE)


def label_from_path(path: Column) -> Column:
    """The label in ``disk.<label>.log``."""
    return F.regexp_extract(path, r"(?:^|/)(?:disk\.)?([^/]*?)(?:\.log)?$", 1)


def format_size(n: Column) -> Column:
    """Bytes in binary units with one decimal."""
    def unit(bits: int, name: str) -> Column:
        size = F.lit(1 << bits)  # tenths by whole numbers, an exact half to the even digit
        tenths = F.floor(n / size).cast("long") * 10 + F.floor((n % size) * 10 / size).cast("long")
        rest = ((n % size) * 10) % size * 2
        up = F.when((rest > size) | ((rest == size) & (tenths % 2 == 1)), 1).otherwise(0)
        return F.format_string("%d.%d " + name, F.floor((tenths + up) / 10).cast("long"), (tenths + up) % 10)

    return F.when(n >= 1 << 30, unit(30, "GiB")).when(n >= 1 << 20, unit(20, "MiB")).when(n >= 1 << 10, unit(10, "KiB")).otherwise(F.format_string("%d B", n))


def parse_size(text: Column) -> Column:
    """Bytes of ``100M``, ``1.5 GB``, ``512k``; null if malformed or negative."""
    trimmed = F.upper(F.trim(text))
    number = F.regexp_extract(trimmed, r"^([0-9]*\.?[0-9]+(?:E[+-]?[0-9]+)?|[0-9]+\.)\s*(?:[KMG]B?)?$", 1)
    unit = F.regexp_extract(trimmed, r"([KMG])B?$", 1)
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(number != "", F.floor(number.try_cast("double") * scale).cast("long"))


def parse_size_c(text: Column) -> Column:
    """The command tool's form: decimal, hexadecimal or octal digits, then K, M, G or T; other suffixes are ignored."""
    digits = F.regexp_extract(text, r"^\s*(0[xX][0-9a-fA-F]+|[0-9]+)", 1)
    base = F.when(digits.rlike("^0[xX]"), F.conv(F.substring(digits, 3, 16), 16, 10)).when(digits.rlike("^0[0-7]+$"), F.conv(digits, 8, 10)).otherwise(digits)
    unit = F.upper(F.regexp_extract(text, r"^\s*(?:0[xX][0-9a-fA-F]+|[0-9]+)([KMGTkmgt])", 1))
    scale = F.when(unit == "K", F.lit(1 << 10)).when(unit == "M", F.lit(1 << 20)).when(unit == "G", F.lit(1 << 30)).when(unit == "T", F.lit(1 << 40)).otherwise(F.lit(1).cast("long"))
    return F.when(digits != "", base.try_cast("long") * scale)


def utc_nanos(ns: Column) -> Column:
    """``2024-01-02 03:04:05.000000006`` of nanoseconds since 1970."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    seconds = F.call_function("div", ns, F.lit(1_000_000_000)) - F.when(ns % 1_000_000_000 < 0, 1).otherwise(0)  # whole numbers, as a double drops nanoseconds
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"))


def align_up(n: Column, to: int = 4096) -> Column:
    return F.floor((n + (to - 1)) / to).cast("long") * to


def block_count(length: Column, block_size: Column | int) -> Column:
    """Whole blocks of a length, one at least."""
    size = F.lit(block_size) if isinstance(block_size, int) else block_size
    return F.greatest(F.floor(length / size).cast("long"), F.lit(1))


def log_key(prefix: str, volume: str, label: Column) -> Column:
    """The object key of a segment."""
    return F.concat(F.lit(f"{prefix.strip('/')}/" if prefix.strip("/") else ""), F.lit(f"{volume}/disk."), label, F.lit(".log"))


def log_key_of(prefix: str, volume: str, label: str) -> str:
    """The same of plain values."""
    return "/".join(x for x in (prefix.strip("/"), volume, f"disk.{label}.log") if x)

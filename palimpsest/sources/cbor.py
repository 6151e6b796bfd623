"""The CBOR subset of logs and control messages: unsigned and negative integers, bytes, text, arrays, maps, booleans, null, floats."""

from __future__ import annotations

import struct


class Truncated(ValueError):
    """The data ends inside an item."""


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise ValueError("integer too large")


def dumps(value) -> bytes:
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (bytes, bytearray, memoryview)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())
    return _head(4, len(value)) + b"".join(map(dumps, value))


def loads(data: bytes, at: int = 0):
    """The item at an offset and the offset after it."""
    if at >= len(data):
        raise Truncated(f"no item at byte {at}")
    major, low = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7 and low in (20, 21, 22, 23):
        return (False, True, None, None)[low - 20], at
    if low < 24:
        n = low
    elif low < 28:
        size = 1 << low - 24
        raw = data[at : at + size]
        if len(raw) < size:
            raise Truncated(f"short head at byte {at}")
        at += size
        if major == 7:
            return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], raw)[0] if size > 1 else raw[0], at
        n = int.from_bytes(raw, "big")
    else:
        raise ValueError(f"indefinite or reserved length at byte {at - 1}")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        raw = data[at : at + n]
        if len(raw) < n:
            raise Truncated(f"short string at byte {at}")
        return (bytes(raw) if major == 2 else bytes(raw).decode()), at + n
    if major == 4:
        out = []
        for _ in range(n):
            item, at = loads(data, at)
            out.append(item)
        return out, at
    if major == 5:
        made = {}
        for _ in range(n):
            key, at = loads(data, at)
            made[key], at = loads(data, at)
        return made, at
    if major == 6:  # a tag's content
        return loads(data, at)
    raise ValueError(f"unknown item at byte {at - 1}")

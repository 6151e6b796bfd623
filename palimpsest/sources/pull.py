"""A pull parser of log segments: items come one by one from a file, which is never in memory whole.

What is not asked for is passed over by seeking, so a scan of geometry reads none of the payloads. Each entry
carries the place of its payload in the file, for reads of single payloads later on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from palimpsest.functions.checks import lz4_unpack
from palimpsest.sources.cbor import Truncated

#: Bytes read at a time: few after a seek, more and more while reading on.
LEAST_CHUNK, CHUNK = 1 << 12, 1 << 18
#: Bytes of a string that is not a payload, and items nested in one another, at most: beyond it the segment is taken to be damaged.
MAX_STRING, MAX_DEPTH = 1 << 24, 64

#: Map keys of the format.
HEADER_KEYS = {1: "version", 2: "block_size", 3: "segment_label", 4: "device_size", 5: "backing_path"}
ENTRY_KEYS = {1: "op", 2: "timestamp_ns", 3: "sequence", 4: "block", 5: "length", 6: "checksum", 7: "data"}


class Damaged(ValueError):
    """A segment that cannot be read on from some byte."""


class Pull:
    """Reads items from a seekable binary file of ``size`` bytes, front to back."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.buffer, self.at, self.base = b"", 0, 0  # base: the buffer's place in the file
        self.chunk, self.bytes_read = LEAST_CHUNK, 0

    @property
    def place(self) -> int:
        return self.base + self.at

    def take(self, n: int) -> bytes:
        if self.place + n > self.size:
            raise Truncated(f"{n} bytes at byte {self.place} of {self.size}")
        if self.at + n > len(self.buffer):
            rest = self.buffer[self.at :]
            self.base, self.at = self.place, 0
            want = max(n - len(rest), min(self.chunk, self.size - self.base - len(rest)))
            self.chunk = min(CHUNK, 2 * self.chunk)
            parts = [rest]
            while want > 0:
                part = self.file.read(want)
                if not part:
                    raise Truncated(f"the file ends at byte {self.base + sum(map(len, parts))}")
                self.bytes_read += len(part)
                want -= len(part)
                parts.append(part)
            self.buffer = b"".join(parts)
        out = self.buffer[self.at : self.at + n]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        """Pass over bytes; what is not in the buffer is not read."""
        if self.place + n > self.size:
            raise Truncated(f"{n} bytes at byte {self.place} of {self.size}")
        if self.at + n <= len(self.buffer):
            self.at += n
        else:
            self.seek(self.place + n)

    def seek(self, place: int) -> None:
        self.base, self.buffer, self.at, self.chunk = place, b"", 0, LEAST_CHUNK
        self.file.seek(place)

    def head(self) -> tuple[int, int, int]:
        """Major kind, length or value, and low bits of the next item's head."""
        first = self.take(1)[0]
        major, low = first >> 5, first & 31
        if low < 24:
            return major, low, low
        if low > 27:
            raise Damaged(f"indefinite or reserved length at byte {self.place - 1}")
        return major, int.from_bytes(self.take(1 << low - 24), "big"), low

    def item(self, depth: int = 0):
        """The next item; of a kind that entries may hold or not."""
        major, n, low = self.head()
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major in (2, 3):
            if n > MAX_STRING:
                raise Damaged(f"a string of {n} bytes at byte {self.place}")
            raw = self.take(n)
            return raw if major == 2 else raw.decode()
        if major == 7:
            if low < 24:
                return {20: False, 21: True}.get(low)
            return n if low == 24 else struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], n.to_bytes(1 << low - 24, "big"))[0]
        if depth >= MAX_DEPTH:
            raise Damaged(f"items nested deeper than {MAX_DEPTH} at byte {self.place}")
        if major == 6:
            return self.item(depth + 1)
        for _ in range(n if major == 4 else 2 * n):  # of no use to a log
            self.item(depth + 1)
        return None

    def pass_over(self, depth: int = 0) -> None:
        """The next item, unread where it is a string."""
        major, n, _ = self.head()
        if major in (2, 3):
            self.skip(n)
        elif major in (4, 5, 6):
            if depth >= MAX_DEPTH:
                raise Damaged(f"items nested deeper than {MAX_DEPTH} at byte {self.place}")
            for _ in range({4: n, 5: 2 * n, 6: 1}[major]):
                self.pass_over(depth + 1)

    def fields(self, names: dict[int, str], payload: bool) -> dict:
        """A map's known fields; the payload's place and stored bytes beside it, or instead of it."""
        start = self.place
        major, n, _ = self.head()
        if major != 5:
            raise Damaged(f"no map at byte {start}")
        out: dict = {name: None for name in names.values()}
        for _ in range(n):
            name = names.get(self.item())
            if name is None:
                self.pass_over()
            elif name != "data":
                out[name] = self.item()
            else:
                kind, size, _ = self.head()
                if kind not in (2, 3):
                    if kind == 7:  # no payload
                        continue
                    raise Damaged(f"a payload of another kind at byte {self.place}")
                out["data_offset"], out["stored"] = self.place, size
                if payload:
                    out["data"] = self.take(size)
                else:
                    self.skip(size)
        return out


def read_header(pull: Pull) -> dict:
    if not pull.size:
        raise Damaged("no header")
    return pull.fields(HEADER_KEYS, False)


def read_entries(pull: Pull, payload: bool = True, ops: set[str] | None = None) -> Iterator[dict]:
    """The entries after the header: fields, ``entry_offset``, ``data_offset`` and ``compressed_size`` of a payload, and the data, unpacked.

    With ``ops``, payloads of other operations are passed over. Ends with the file; raises where it can't be read on.
    """
    while pull.place < pull.size:
        start = pull.place
        entry = pull.fields(ENTRY_KEYS, payload and ops is None)
        if payload and ops is not None and entry["op"] in ops and entry.get("data_offset") is not None:
            end = pull.place
            pull.seek(entry["data_offset"])
            entry["data"] = pull.take(entry["stored"])
            pull.skip(end - pull.place)
        stored = entry.pop("stored", None)
        for name in ("timestamp_ns", "sequence", "block", "length", "checksum"):
            if entry[name] is not None and not isinstance(entry[name], int):
                raise Damaged(f"{name} is no number in the entry at byte {start}")
        if entry["op"] is not None and not isinstance(entry["op"], str):
            raise Damaged(f"op is no text in the entry at byte {start}")
        packed = entry["op"] == "W" and bool(stored) and bool(entry["length"])
        entry["compressed_size"] = stored if entry["op"] == "W" and stored else None
        entry["entry_offset"] = start
        entry.setdefault("data_offset", None)
        if packed and entry["data"] is not None:
            entry["data"] = lz4_unpack(entry["data"], entry["length"])
        yield entry

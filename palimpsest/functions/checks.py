"""Checksums and compression that Spark lacks: CRC-32C and raw LZ4 blocks, as Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType

#: Castagnoli polynomial, reflected.
_POLYNOMIAL = 0x82F63B78


#: Bytes of a value that are summed up side by side with those of others, and bytes of values handled at a time.
_STRIDE, _GROUP = 256, 16 << 20


@lru_cache
def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


@lru_cache
def _shift() -> np.ndarray:
    """What ``_STRIDE`` zero bytes make of a state, byte of the state by byte."""
    table = _table()
    c = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(_STRIDE):
        c = table[c & 0xFF] ^ (c >> 8)
    return c


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """The CRC-32C of each value. A value's odd first bytes go in one by one, side by side over all values; the rest in strides that are summed up side by side, too, and then joined."""
    table, shift = _table(), _shift()
    lengths = np.array([len(v) for v in values], np.int64)
    state = np.full(len(values), 0xFFFFFFFF, np.uint32)
    data = np.frombuffer(b"".join(values), np.uint8)
    starts, odd = np.cumsum(lengths) - lengths, lengths % _STRIDE
    for i in range(int(odd.max()) if len(odd) else 0):
        at = np.flatnonzero(odd > i)
        state[at] = table[(state[at] ^ data[starts[at] + i]) & 0xFF] ^ (state[at] >> 8)
    strides = lengths // _STRIDE
    first = np.cumsum(strides) - strides
    owner = np.repeat(np.arange(len(values)), strides)
    begin = starts[owner] + odd[owner] + (np.arange(len(owner)) - first[owner]) * _STRIDE
    sums = np.zeros(len(owner), np.uint32)
    for i in range(_STRIDE if len(owner) else 0):
        sums = table[(sums ^ data[begin + i]) & 0xFF] ^ (sums >> 8)
    for k in range(int(strides.max()) if len(strides) else 0):
        at = np.flatnonzero(strides > k)
        c = state[at]
        state[at] = shift[0][c & 0xFF] ^ shift[1][c >> 8 & 0xFF] ^ shift[2][c >> 16 & 0xFF] ^ shift[3][c >> 24] ^ sums[first[at] + k]
    return ~state


def crc32c(data: bytes) -> int:
    return int(crc32c_many([bytes(data)])[0])


@pandas_udf(LongType())
def crc32c_col(data: pd.Series) -> pd.Series:
    """CRC-32C of each value; null of null."""
    values = [b if b is not None else b"" for b in data]
    out, a = np.empty(len(values), np.int64), 0
    while a < len(values):
        b, held = a + 1, len(values[a])
        while b < len(values) and held + len(values[b]) <= _GROUP:
            held += len(values[b])
            b += 1
        out[a:b] = crc32c_many(values[a:b])
        a = b
    return pd.Series(out).where(data.notna().to_numpy()).astype("Int64")


def lz4_pack(data: bytes) -> bytes:
    return pa.Codec("lz4_raw").compress(data, asbytes=True)


def lz4_unpack(data: bytes, length: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, decompressed_size=length, asbytes=True)


@pandas_udf(BinaryType())
def lz4_compress(data: pd.Series) -> pd.Series:
    return data.map(lz4_pack, na_action="ignore")


@pandas_udf(BinaryType())
def lz4_decompress(data: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else lz4_unpack(d, int(n)) for d, n in zip(data, length)])


def crc_valid(op: Column, data: Column, checksum: Column) -> Column:
    """Trims are valid; a write's CRC-32 must equal its checksum."""
    return (op == "T") | F.coalesce(F.crc32(data) == checksum, F.lit(False))


def is_magic(content: Column) -> Column:
    """Whether a file is a cluster image."""
    return F.substring(content, 1, 8) == F.unhex(F.lit("4C42444351573200"))

"""Arrow batch plumbing: flat UTF-8 buffers, span hashes, column appending."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.runtime import prepare

#: Bytes and spans hashed at a time; bounds the temporary arrays.
PIECE_BYTES, SPANS = 1 << 20, 1 << 17
#: Bytes of text handled as one group of documents.
GROUP_BYTES = 4 << 20
#: Buckets of ordered rows: cuts by quantiles at most, and parts of what lies between two cuts at most.
MAX_CUTS, MAX_PARTS = 10_000, 100
_BASE = 0x9E3779B97F4A7C15 | 1
_LANES = np.array([0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7], np.uint64)
_PLACE, _LENGTH = np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Word breaks: space and \t \n \v \f \r.
SPACE_TABLE = np.zeros(256, dtype=bool)
SPACE_TABLE[[0x20, *range(0x09, 0x0E)]] = True
LINE_TABLE = np.zeros(256, dtype=bool)
LINE_TABLE[0x0A] = True
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets (from 0) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document of the maximal runs without break bytes, never across documents."""
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, docs


def _words_at(words: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ``count`` (1 to 8) bytes from each offset as little-endian numbers; ``words`` are the aligned ones, two spare at the end."""
    cell, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    low = words[cell] >> shift
    low |= (words[cell + 1] << (np.uint64(63) - shift)) << np.uint64(1)  # no shift by 64
    return low & _MASKS[count]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. Two lanes make 128 bits.

    Each eight bytes are mixed with their place in the span, and the mixed values are added up, so
    no two ordinary texts collide by their structure, as they can in a polynomial modulo 2^64.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.uint64)
    words = np.zeros(len(data) // 8 + 3, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    key, length, out = _LANES[lane], ends - starts, np.empty(n, np.uint64)
    for a in range(0, n, SPANS):  # bounds the temporary arrays
        part = slice(a, a + SPANS)
        out[part] = mix(_words_at(words, starts[part], np.minimum(length[part], 8)) ^ key)
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) // 8  # words behind the first
        after = np.cumsum(more)
        for a in range(0, int(after[-1]), PIECE_BYTES // 8):  # bounds the temporary arrays
            at = np.arange(a, min(a + PIECE_BYTES // 8, int(after[-1])))
            owner = np.searchsorted(after, at, side="right")
            place = at - (after - more)[owner] + 1
            span = long[owner]
            first = starts[span] + 8 * place
            terms = mix(_words_at(words, first, np.minimum(ends[span] - first, 8)) ^ mix(key + place.astype(np.uint64) * _PLACE))
            fresh = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[span[fresh]] += np.add.reduceat(terms, fresh)
    for a in range(0, n, SPANS):
        part = slice(a, a + SPANS)
        out[part] = mix(out[part] + length[part].astype(np.uint64) * _LENGTH)
    return out


def shingle_hashes(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows inside each document and the document of each."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, docs.dtype)
    h = np.full(n, np.uint64(k))
    for a in range(0, n, SPANS):  # bounds the temporary arrays
        part = h[a : a + SPANS]
        for j in range(k):
            part = mix(part * np.uint64(_BASE) + words[a + j : a + j + len(part)])
        h[a : a + SPANS] = part
    whole = docs[:n] == docs[k - 1 :]
    return h[whole], docs[:n][whole]


def window_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of windows, one row of word hashes each."""
    h = np.full(len(words), np.uint64(words.shape[1]))
    for j in range(words.shape[1]):
        h = mix(h * np.uint64(_BASE) + words[:, j])
    return h


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the input lacks."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


class Buckets:
    """Consecutive numbers for ranges of (key, hash), ascending, from quantiles of the keys.

    What lies between two quantiles is cut further in even steps of the key; a key that holds
    several quantiles alone is cut by the hash. At most ``MAX_CUTS * MAX_PARTS`` buckets in all.
    """

    def __init__(self, quantiles: list[int], n: int, rows: int):
        least = -(1 << 63)
        cuts = sorted({*quantiles, *(a - 1 for a, b in zip(quantiles, quantiles[1:]) if a == b and a > least)})
        share = n / (len(quantiles) + 1)
        held = Counter(quantiles)
        self.cuts = cuts
        self.parts = [min(MAX_PARTS * max(1, held[c]), max(1, math.ceil(share * max(1, held[c]) / rows))) for c in cuts] + [min(MAX_PARTS, max(1, math.ceil(share / rows)))]
        self.first = list(accumulate([0, *self.parts]))[:-1]

    def __call__(self, key: Column, hash_: Column) -> Column:
        """The bucket of a row."""
        if not self.cuts:
            return F.lit(0)
        listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  one literal, folded
        step = max(1, math.isqrt(len(self.cuts)))
        coarse = F.size(F.filter(listed(self.cuts[step - 1 :: step]), lambda c: c < key)) * step
        at = coarse + F.size(F.filter(F.slice(listed(self.cuts), coarse + 1, F.lit(step)), lambda c: c < key))
        parts, low, high = F.get(listed(self.parts), at), F.get(listed(self.cuts), at - 1), F.get(listed(self.cuts), at)
        alone = (F.shiftright(hash_, 40) + (1 << 23)) / F.lit(float(1 << 24))
        share = F.when(high == low + 1, alone).otherwise((key.cast("double") - low) / (high.cast("double") - low + 1))
        inner = F.least(F.greatest(F.floor(F.coalesce(share, F.lit(0.0)) * parts), F.lit(0)), parts - 1)
        return (F.get(listed(self.first), at) + inner).cast("int")

    @classmethod
    def of(cls, df: DataFrame, key: str, rows: int) -> "Buckets":
        """Buckets of about ``rows`` rows of a table by a column of 64-bit integers."""
        n = df.count()
        cuts = min(MAX_CUTS, -(-n // rows))
        shares = [i / cuts for i in range(1, cuts)]
        return cls(list(df.select(F.percentile_approx(key, shares, 10 * cuts).alias("s")).first()["s"]) if shares else [], n, rows)

    @property
    def count(self) -> int:
        """Numbers in all."""
        return sum(self.parts)


def append_columns(df: DataFrame, text_col: str, start: Callable[[], Callable], fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns (or ``keep``) plus ``fields``, computed batch by batch from the text column.

    ``start()`` runs once per task and returns a function from an Arrow text array to one Arrow
    array per field. A field replaces an input column of the same name.
    """
    prepare(df.sparkSession)
    added = {f.name for f in fields}
    names = [c for c in (df.columns if keep is None else keep) if c not in added]
    schema = T.StructType([df.schema[c] for c in names] + fields)
    source = df.select(*[df[c] for c in names], df[text_col].cast("string").alias("__text"))

    def run(it):
        step = start()
        for batch in it:
            if not batch.num_rows:
                continue
            made = step(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if "<" in kind else {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}[kind])

"""Words of letters, digits and non-ASCII bytes, found in Arrow UTF-8 buffers by a byte automaton.

A lookup table classes each byte, differences of the classes are the word boundaries, and a table-driven CRC-32
advances over all words at once, byte by byte. Texts are handled in pieces of bounded size, cut between words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from palimpsest.llm.batches import LOWER_TABLE, flat, spans

#: Bytes of a piece, unless one word is longer; bounds the temporary arrays.
PIECE = 4 << 20
#: Bytes of a word that advance together; the few longer words end one at a time.
STEPS = 48

#: Word breaks: ASCII but digits and letters.
BREAK_TABLE = np.ones(256, dtype=bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    BREAK_TABLE[_low:_high] = False


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC_TABLE = _crc_table()


def _cut(data: np.ndarray, offsets: np.ndarray, a: int, size: int) -> int:
    """Where the piece that begins at ``a`` ends: the last place within ``size`` bytes that splits no word, else the end of the word."""
    b = a + size
    if b >= len(data):
        return len(data)
    row = int(np.searchsorted(offsets, b, side="right"))
    back = np.flatnonzero(BREAK_TABLE[data[a:b]])
    cut = max(int(offsets[row - 1]), a + int(back[-1]) + 1 if len(back) else 0)
    if cut > a:
        return cut
    end = int(offsets[row])
    for at in range(b, end, size):
        ahead = np.flatnonzero(BREAK_TABLE[data[at : min(at + size, end)]])
        if len(ahead):
            return at + int(ahead[0])
    return end


def word_pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, and starts, ends and row of the words, piece by piece; null counts as empty."""
    data, offsets = flat(column)
    a = 0
    while a < len(data):
        b = _cut(data, offsets, a, size)
        first = int(np.searchsorted(offsets, a, side="right")) - 1
        last = int(np.searchsorted(offsets, b, side="left"))
        part = LOWER_TABLE[data[a:b]]
        starts, ends, docs = spans(part, np.clip(offsets[first : last + 1], a, b) - a, BREAK_TABLE)
        yield part, starts, ends, docs + first
        a = b


def crc32_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each word's bytes: all states advance together, words leave as they end."""
    out = np.empty(len(starts), np.uint32)
    alive, at, left = np.arange(len(starts)), starts, ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for _ in range(STEPS):
        if not len(alive):
            return out
        state = CRC_TABLE[(state ^ data[at]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        more = left > 1
        out[alive[~more]] = ~state[~more]
        alive, at, left, state = alive[more], at[more] + 1, left[more] - 1, state[more]
    for i, a, n, c in zip(alive.tolist(), at.tolist(), left.tolist(), state.tolist()):
        out[i] = zlib.crc32(data[a : a + n], c ^ 0xFFFFFFFF)
    return out

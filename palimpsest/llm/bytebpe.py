"""Whole-text byte-level BPE encoding with bounded caches of words.

The tokenizer never merges across a chunk (an optional space and a run without white space, or
a run of white space split before its last character), so a text's ids are the ids of its chunks
in order. Texts are split at single spaces, and each part is remembered with the ids of a space
and itself; texts with longer runs of white space go through an exact pattern. What the caches
lack is cut by the tokenizer's own pattern and merged by the library's model. A text that holds
an added token goes to the library whole, as that token changes the white space around it.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import regex

#: Unicode White_Space, as the pre-tokenizer's \s sees it.
_S = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_WHITE = frozenset(re.compile(f"[{_S}]").findall("".join(map(chr, range(0x3001)))))
#: Marks that are neither letters, numbers nor an apostrophe, which the pattern treats by itself.
MARKS = ",.;:!?)]}|%&$#*\""
#: The pre-tokenizer's pattern (a fixed value of the byte-level format).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where visible in Latin-1, else from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Packers of a few ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
_LOADED: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; at most ``limit`` chunks are remembered."""

    def __init__(self, path: str, limit: int = 400_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.longest = limit, longest
        self.known: dict[str, bytes] = {}  # ids of a space and the part
        self.words: dict[str, bytes] = {}  # ids of a word
        self.white: set[str] = {""}  # parts that a longer run of white space may touch
        self.merge = self.tokenizer.model.tokenize
        self._space = byte_alphabet()[0x20]
        self._latin = {b: c for b, c in byte_alphabet().items()}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = added

    @classmethod
    def load(cls, path: str) -> "ChunkEncoder":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        return self._ids(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._latin))

    def _ids(self, mapped: str) -> bytes:
        ids = [t.id for t in self.merge(mapped)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _spaced(self, stem: str) -> bytes:
        """Ids of a space and letters; those of ASCII stand for themselves."""
        return self._ids(self._space + stem) if stem.isascii() else self._merged(" " + stem)

    def _part(self, part: str) -> bytes:
        """Ids of a space and a part; letters with marks behind them are two words of the pattern."""
        stem = part.rstrip(MARKS)
        if not stem.isalpha():
            return self._chunk(" " + part)
        if len(stem) == len(part):
            return self._spaced(stem)
        b = self.known.get(stem)
        if b is None:
            b = self._spaced(stem)
            if len(stem) <= self.longest:
                self.known[stem] = b
        tail = part[len(stem) :]
        return b + (self.words.get(tail) or self._chunk(tail))

    def _chunk(self, chunk: str) -> bytes:
        words, out = self.words, []
        for w in WORDS(chunk):
            if (b := words.get(w)) is None:
                b = self._merged(w)
                if len(w) <= self.longest:
                    if len(words) >= self.limit:
                        words.clear()
                    words[w] = b
            out.append(b)
        return b"".join(out)

    def _one(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._library(text)
        known, parts = self.known, text.split(" ")
        first = parts[0]
        rest = parts[1:]
        if not self.white.isdisjoint(parts):
            return b"".join(map(self._chunk, CHUNKS(text)))
        try:
            return self._chunk(first) + b"".join(map(known.__getitem__, rest))
        except KeyError:
            pass
        new = {p for p in rest if p not in known}
        if len(known) + len(new) > self.limit:  # start over
            known.clear()
            new = set(rest)
        touched, long = not first or first[-1] in _WHITE, []
        for p in new:
            if not p or p[-1] in _WHITE:
                if len(p) <= self.longest:
                    self.white.add(p)
                touched = True
            else:
                known[p] = self._part(p)
                if len(p) > self.longest:
                    long.append(p)
        if len(self.white) > self.limit:
            self.white = {""}
        if touched:
            for p in long:
                del known[p]
            return b"".join(map(self._chunk, CHUNKS(text)))
        out = self._chunk(first) + b"".join(map(known.__getitem__, rest))
        for p in long:
            del known[p]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: empty) as bytes."""
        return [self._one(t) if t else b"" for t in texts]

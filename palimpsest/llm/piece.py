"""Exact SentencePiece BPE encoding by backtracking (operator 4).

An Aho-Corasick automaton over the vocabulary finds every piece at every position. The encoder
takes the longest piece at a position whose pair with the piece before it is compatible, that is,
re-merging the two together gives the two again; where none is, it marks the position as failed
in a bitfield, drops the last piece and tries the next shorter one. A sequence whose pieces are
compatible pair by pair is what the merges make of the whole, so the result is exact.

No piece crosses from a non-space symbol to a space symbol, nor holds a symbol outside the
vocabulary, so texts are cut there and the ids of short segments are remembered (bounded).
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from palimpsest.llm.batches import append_columns, field

SPACE = "▁"
_LOADED: dict[str, "BacktrackEncoder"] = {}


def symbols_of(pieces) -> list[str]:
    return sorted({c for p in pieces for c in p})


class BacktrackEncoder:
    """Encoder for a BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str, limit: int = 500_000, longest: int = 48):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        n = sp.get_piece_size()
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.id = {p: sp.piece_to_id(p) for p in self.score}
        self.bytes_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or sp.normalize(" Ａ\t x") != "▁▁Ａ\t▁x":
            raise ValueError("the model's pieces or normaliser are of another kind")
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.score), None) for p in self.score}
        touching = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        letters = [c for c in symbols_of(self.score) if c.isalpha()]
        apart = [c for c in symbols_of(self.score) if not c.isalpha() and c != SPACE and not any(x + c in touching for x in letters)]
        # no piece holds a letter followed by one of these symbols
        self.cut = re.compile(f"(?<=[{re.escape(''.join(letters))}])(?=[{re.escape(''.join(apart))}])").split if apart else lambda t: [t]
        symbols = "".join(c for c in symbols_of(self.score) if c != SPACE)
        known = "[" + re.escape(symbols) + "]"
        # spaces with what follows them; or one symbol outside the vocabulary
        self.split = re.compile(f"{SPACE}*{known}+|{SPACE}+|[\\s\\S]").findall
        self.limit, self.longest = limit, longest
        self.known: dict[str, bytes] = {}  # ids of a space and the part
        self.segments: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def load(cls, path: str) -> "BacktrackEncoder":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def merged(self, text: str) -> list[str]:
        """What the merges make of a text: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return ok

    def pieces(self, text: str, longest: list[str | None]) -> list[str]:
        """Backtracking; ``longest``: the longest piece that starts at each position."""
        end, at, out, last = len(text), 0, [], ""
        failed = 0  # a bit for each position from which no sequence leads on
        shorter, pairs = self.shorter, self.pairs
        piece = longest[0]
        while at < end:
            while piece is not None:
                to = at + len(piece)
                if not failed >> to & 1:
                    ok = pairs.get((last, piece))
                    if ok or ok is None and self.compatible(last, piece):
                        out.append(piece)
                        at, last = to, piece
                        piece = longest[at] if at < end else None
                        break
                piece = shorter[piece]
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << at
                dropped = out.pop()
                at -= len(dropped)
                last = out[-1] if out else ""
                piece = shorter[dropped]
        return out

    def _learn(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of segments; one pass of the automaton over all of them."""
        joined = "\n".join(texts)
        longest: list[str | None] = [None] * (len(joined) + 1)
        for last, piece in self.automaton.iter(joined):  # ends ascend, so the longest of a start comes last
            longest[last - len(piece) + 1] = piece
        ids, at, got = self.id.__getitem__, 0, {}
        for text in texts:
            n = len(text)
            if n == 1 and text not in self.id:
                made = [self.bytes_id[b] for b in text.encode("utf-8", "surrogatepass")]
            else:
                made = list(map(ids, self.pieces(text, longest[at : at + n])))
            got[text] = struct.pack(f"<{len(made)}I", *made)
            at += n + 1
        return got

    def _whole(self, parts: list[str]) -> list[bytes]:
        """Ids of texts whose spaces are marked, cut into segments first."""
        known = self.segments
        cut = [[s for x in self.split(p) for s in self.cut(x)] for p in parts]
        new = {s for doc in cut for s in doc if s not in known}
        if len(known) + len(new) > self.limit:
            known.clear()
            new = {s for doc in cut for s in doc}
        wanted = list(new)
        for a in range(0, len(wanted), 2000):
            known.update(self._learn(wanted[a : a + 2000]))
        get = known.__getitem__
        out = [b"".join(map(get, doc)) for doc in cut]
        for s in wanted:
            if len(s) > self.longest:
                del known[s]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty), without begin and end ids, as little-endian 32-bit integers."""
        known = self.known
        # single spaces bound segments; other texts are cut by the pattern
        cut = [t.split(" ") if t else [] for t in texts]
        odd = {i for i, doc in enumerate(cut) if "" in doc or SPACE in (texts[i] or "")}
        new = {p for i, doc in enumerate(cut) if i not in odd for p in doc if p not in known}
        if len(known) + len(new) > self.limit:
            known.clear()
            new = {p for i, doc in enumerate(cut) if i not in odd for p in doc}
        wanted = list(new)
        for a in range(0, len(wanted), 2000):
            part = wanted[a : a + 2000]
            known.update(zip(part, self._whole([SPACE + p for p in part])))
        get = known.__getitem__
        out = [self._whole([SPACE + texts[i].replace(" ", SPACE)])[0] if i in odd else b"".join(map(get, doc)) for i, doc in enumerate(cut)]
        for p in wanted:
            if len(p) > self.longest:
                del known[p]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def sentencepiece_round_trip(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; also ``ids`` and ``decoded`` if ``with_ids``.

    Begin and end ids are added. Null and empty texts give these two ids alone and decode to an
    empty text. Rows are independent, so repeated rows get equal results and an empty table none.
    """

    def start():
        coder = BacktrackEncoder.load(model_path)
        bos, eos = (np.array([i], "<u4").tobytes() for i in (coder.bos, coder.eos))

        def step(column: pa.Array) -> list[pa.Array]:
            texts, counts, ids_hash, text_hash, all_ids, all_text = column.to_pylist(), [], [], [], [], []
            for a in range(0, len(texts), 128):
                for body in coder.encode(texts[a : a + 128]):
                    body = bos + body + eos
                    ids = np.frombuffer(body, "<u4")
                    decoded = coder.decode(ids.tolist())
                    counts.append(len(ids))
                    ids_hash.append(hashlib.sha256(body).hexdigest())
                    text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int64))
                        all_text.append(decoded)
            made = [pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
            return made + ([pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_text, pa.string())] if with_ids else [])

        return step

    fields = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), field("decoded", "string")]
    return append_columns(docs, text_col, start, fields, keep)

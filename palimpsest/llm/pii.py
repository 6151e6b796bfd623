"""Personal data by exact patterns and a semi-Markov conditional random field (operator 5).

The exact patterns give the base spans, which always stay. Around triggers (digits, at signs, long
runs, spelt-out addresses, keywords) the field scores every segment from token boundary to token
boundary, up to a bound of tokens for each kind, by features of the whole segment: its digits and
groups, separators, first and last token, checks such as Luhn, and what stands beside it; moves
between labels have scores too. Dynamic programming over segment ends picks boundaries and kinds of
all spans of a text jointly; spans of the base are fixed in it. Weights are trained by the exact
gradient of the log likelihood on sentences that a seeded generator writes, so there are no labels
to collect and no model file to ship.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.batches import append_columns, field

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds the field may give, in output order.
KINDS = [*BASE_KINDS, "secret", "account"]
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
#: The same matches: each starts a run of digits, and no shorter run helps.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start."""
    out = []
    if "@" in text:
        out += _emails(text)
    digit = _DIGIT(text)
    if digit:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = re.sub("[^0-9]", "", m.group())
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


_DIGIT = re.compile("[0-9]").search
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Matches of the e-mail pattern; each is sought only from the run of local characters before an at sign."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := EMAIL.match(text, a)):
            out.append(("email", *m.span()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


# ---- the field

#: Kinds the field may give besides the base's, and the tokens of a segment at most, by kind.
LONGEST = {"email": 48, "ip": 20, "card": 12, "phone": 14, "secret": 12, "account": 20}
#: Text looked at around each trigger, and the widest gap inside a segment.
REACH, GAP = 96, 3

_TOKEN = re.compile(r"[A-Za-z0-9_/+-]{24,}+={0,2}|[A-Za-z]+|[0-9]+|[^\W\d_]+|[^\sA-Za-z0-9]")
_CUES = {
    "phone": "phone tel telephone telefon call mobile mobil fax cell ring anruf appelez llame teléfono téléphone handy",
    "email": "mail email contact write reach e-mail kontakt correo courriel",
    "card": "card visa mastercard amex credit karte carte tarjeta",
    "secret": "token secret password passwd pwd key apikey passwort",
    "account": "account iban konto cuenta compte bic",
    "ip": "host ip server address addr",
}
_ENDS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"}
_CUE = {w: i + 1 for i, words in enumerate(_CUES.values()) for w in words.split()}
#: Every segment holds a trigger or follows one: digits in a row, an at sign, a long run, the word "dot", or a keyword with a sign behind it.
_TRIGGER = re.compile(r"[0-9]{2,}|@|[A-Za-z0-9_/+-]{24,}+|(?i:\bdot\b)|(?i:\b(?:token|secret|password|passwd|pwd|api[_ -]?key|key|passwort)[\"']?\s{0,4}[=:])")
_SYMBOLS = {c: i for i, group in enumerate(["([", ")]", ".", "-", "+", "@", "/", ":=", "\"'", ",;"]) for c in group}
_CLASSES = 22  # edge, digits, lower, capital, upper, other word, long hex, long mixed, long other, ten symbols, other symbol, "at", "dot"
_DIGITS, _LOWER, _CAPITAL, _UPPER, _WORD, _HEX, _MIXED, _LONG, _SIGN, _OTHER, _AT, _DOT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 19, 20, 21


def _class(t: str) -> int:
    """The class of a token."""
    if len(t) >= 24 and t[-1] in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+-=" and not (t.isascii() and t.isalpha() or t.isdigit()):
        digit, letter = any(c.isdigit() for c in t), any(c.isalpha() for c in t)
        if digit and letter:
            return _HEX if all(c in "0123456789abcdefABCDEF" for c in t) else _MIXED
        return _LONG
    if t[0] in "0123456789":
        return _DIGITS
    if t[0].isalpha():
        low = t.lower()
        return _AT if low == "at" else _DOT if low == "dot" else _LOWER if t == low else _UPPER if t == t.upper() else _CAPITAL if t[1:] == low[1:] else _WORD
    return _SIGN + _SYMBOLS[t] if t in _SYMBOLS else _OTHER


class Tokens:
    """The tokens of the parts of texts around triggers, and sums that make any segment's features a few differences."""

    def __init__(self, texts: list[str]):
        start, end, kind, digits, letters, small, cue, fresh, gap, doc, top = ([] for _ in range(11))
        self.texts = texts
        for n, text in enumerate(texts):
            for lo, hi in _regions(text):
                last = None
                for m in _TOKEN.finditer(text, lo, hi):
                    t, a = m.group(), m.start()
                    k = _class(t)
                    start.append(a), end.append(m.end()), kind.append(k), doc.append(n)
                    d = len(t) if k == _DIGITS else sum(c.isdigit() for c in t) if _HEX <= k <= _LONG else 0
                    digits.append(d), letters.append(len(t) - d if k not in (_DIGITS,) and not _SIGN <= k <= _OTHER else 0)
                    small.append(k == _DIGITS and d <= 3 and int(t) <= 255)
                    cue.append(_CUE.get(t.lower(), 0) if _LOWER <= k <= _WORD else 0)
                    between = text[last:a] if last is not None else ""
                    top.append(t.lower() in _ENDS)
                    fresh.append(last is None or len(between) > GAP or "\n" in between)
                    gap.append(bool(between))
                    last = m.end()
        self.start, self.end, self.kind, self.doc = (np.array(x, np.int64) for x in (start, end, kind, doc))
        self.digits, self.fresh, self.gap = np.array(digits, np.int64), np.array(fresh, bool), np.array(gap, bool)
        n = len(start)
        kinds, self.top = self.kind, np.array(top, np.int64)
        flags = [self.digits, kinds == _DIGITS, np.array(letters, np.int64), np.array(small, np.int64), self.fresh, self.gap, (kinds >= _HEX) & (kinds <= _LONG), kinds == _AT, kinds == _DOT, (kinds >= _LOWER) & (kinds <= _WORD)]
        flags += [kinds == _SIGN + i for i in range(10)] + [kinds == _OTHER]
        self.sums = np.zeros((n + 1, len(flags)), np.int64)
        if n:
            self.sums[1:] = np.cumsum(np.stack(flags, axis=1), axis=0)
        # the nearest cue among the five tokens before, within the region
        cues, region = np.array(cue, np.int64), np.cumsum(np.array([f and not g for f, g in zip(fresh, gap)], bool))
        self.cue = np.zeros(n, np.int64)
        for d in (5, 4, 3, 2, 1):
            if n > d:
                hit = np.where(region[d:] == region[:-d], cues[:-d], 0)
                self.cue[d:] = np.where(hit > 0, hit, self.cue[d:])

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ranges ``i, j`` that could be of some kind, and their feature cells (one column a feature)."""
        n = len(self.kind)
        size = np.where(self.kind == _DIGITS, self.digits, 0)
        longest, shortest = np.zeros(n, np.int64), np.full(n, 99)
        out: list[tuple[np.ndarray, ...]] = []
        head = np.isin(self.kind, [_DIGITS, _LOWER, _CAPITAL, _UPPER, _WORD, _HEX, _MIXED, _LONG, _SIGN, _SIGN + 4])
        tail = np.isin(self.kind, [_DIGITS, _LOWER, _CAPITAL, _UPPER, _WORD, _HEX, _MIXED, _LONG])
        alive = np.flatnonzero(head)
        for d in range(1, max(LONGEST.values()) + 1):
            alive = alive[alive + d <= n]
            if d > 1:
                alive = alive[~self.fresh[alive + d - 1]]
            if not len(alive):
                break
            i, j = alive, alive + d
            longest[i] = np.maximum(longest[i], size[j - 1])
            shortest[i] = np.where(size[j - 1] > 0, np.minimum(shortest[i], size[j - 1]), shortest[i])
            x = self.sums[j] - self.sums[i]
            chars = self.end[j - 1] - self.start[i]
            inner_gaps = x[:, 5] - self.gap[i]
            keyed = (self.cue[i] == _CUE["key"]) & (inner_gaps == 0) & (chars >= 8)
            some = (x[:, 0] >= 7) & (x[:, 2] <= 40) | (x[:, 1] == 4) & (x[:, 0] >= 4) | (x[:, 15] > 0) | (x[:, 7] > 0) & (x[:, 8] > 0) | (x[:, 6] > 0) & (d <= 2) | keyed
            keep = some & tail[j - 1]
            if keep.any():
                out.append((i[keep], j[keep], x[keep], chars[keep], inner_gaps[keep], longest[i[keep]].copy(), shortest[i[keep]].copy()))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(_SIZES)), np.int64)
        i, j, x, chars, gaps, most, least = (np.concatenate(c) for c in zip(*out))
        return i, j, self._cells(i, j, x, chars, gaps, most, least)

    def _cells(self, i, j, x, chars, gaps, most, least) -> np.ndarray:
        n, kinds = len(self.kind), self.kind
        joined = lambda at, off: np.where(self.fresh[at], 0, np.where(self.gap[at], 1, 2)) if off else None
        before = np.where(~self.fresh[i], kinds[np.maximum(i - 1, 0)], 0)
        after_at = np.minimum(j, n - 1)
        follows = (j < n) & ~self.fresh[after_at]
        after = np.where(follows, kinds[after_at], 0)
        touch_before = joined(i, True)
        touch_after = np.where(follows, np.where(self.gap[after_at], 1, 2), 0)
        digits, groups = x[:, 0], x[:, 1]
        check = np.zeros(len(i), np.int64)
        for r in np.flatnonzero((digits >= 13) & (digits <= 19) & (x[:, 2] == 0)):
            check[r] = 1 + luhn(re.sub("[^0-9]", "", self._text(i[r], j[r])))
        account = np.zeros(len(i), np.int64)
        for r in np.flatnonzero((digits >= 8) & (chars >= 15) & (chars <= 44) & np.isin(kinds[i], [_UPPER, _LOWER, _HEX, _MIXED])):
            account[r] = 1 + _mod97(self._text(i[r], j[r]))
        # spelt-out addresses: gaps up to the first "at", tokens behind the last "dot"
        place = np.arange(n)
        next_at = np.minimum(np.minimum.accumulate(np.where(kinds == _AT, place, n)[::-1])[::-1][i], n - 1)
        last_dot = np.maximum.accumulate(np.where(kinds == _DOT, place, -1))[j - 1]
        local = np.where((x[:, 7] > 0), 1 + np.minimum(self.sums[next_at + 1, 5] - self.sums[i + 1, 5], 3), 0)
        domain = np.where(x[:, 8] > 0, 1 + np.minimum(j - 1 - last_dot, 3), 0)
        bucket = lambda v, edges: np.searchsorted(edges, v, side="right")
        columns = [
            np.zeros(len(i), np.int64), np.minimum(digits, 20), np.minimum(groups, 9), bucket(x[:, 2], [1, 2, 3, 6, 13, 25]), np.minimum(j - i, 49) // 2, bucket(chars, [6, 8, 10, 12, 16, 20, 24, 32, 48]),
            kinds[i], kinds[j - 1], before, after, touch_before * 3 + touch_after, self.cue[i], np.minimum(gaps, 5), check, account,
            (groups == 4) * (1 + (x[:, 3] == 4)), np.minimum(most, 9), np.minimum(least, 9), np.minimum(x[:, 7], 2), np.minimum(x[:, 8], 3), np.minimum(x[:, 9], 4), np.minimum(x[:, 6], 2),
            local, domain, np.where(x[:, 8] > 0, 1 + self.top[j - 1], 0), *(np.minimum(x[:, 10 + s], 4) for s in range(11)),
            np.minimum(groups, 9) * 10 + np.minimum(most, 9), self.cue[i] * 11 + np.minimum(digits // 2, 10), kinds[i] * _CLASSES + kinds[j - 1],
        ]
        return np.stack(columns, axis=1) + _OFFSETS

    def _text(self, i: int, j: int) -> str:
        return self.texts[self.doc[i]][self.start[i] : self.end[j - 1]]


_SIZES = np.array([1, 21, 10, 7, 25, 10, _CLASSES, _CLASSES, _CLASSES, _CLASSES, 9, len(_CUES) + 1, 6, 3, 3, 3, 10, 10, 3, 4, 5, 3, 5, 5, 3, *[5] * 11, 100, (len(_CUES) + 1) * 11, _CLASSES * _CLASSES])
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
_FIELD = list(LONGEST)
_N = len(_FIELD)
_BOUND = np.array([LONGEST[k] for k in _FIELD])


def _mod97(text: str) -> bool:
    """Whether a bank account number's check digits hold."""
    t = "".join(text.split()).upper()
    if not (15 <= len(t) <= 34 and t.isascii() and t.isalnum() and t[:2].isalpha() and t[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _regions(text: str) -> list[list[int]]:
    """The parts of a text within ``REACH`` of a trigger, ends moved to white space near them."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    for r in out:  # a word cut in two stays out, if it is no longer than the reach
        if 0 < r[0] and (space := _WHITE(text, r[0], min(r[0] + REACH, r[1]))):
            r[0] = space.start()
        if r[1] < len(text):
            cut = max(text.rfind(" ", max(r[0], r[1] - REACH), r[1]), text.rfind("\n", max(r[0], r[1] - REACH), r[1]))
            r[1] = cut if cut >= 0 else r[1]
    return [r for r in out if r[0] < r[1]]


_WHITE = re.compile(r"\s").search


class Field:
    """Weights of a semi-Markov field: ``cells`` (feature cell, kind) and ``moves`` (label before, label; the last is no kind, which moves to itself at no cost)."""

    def __init__(self, cells: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.cells = np.zeros((int(_SIZES.sum()), _N)) if cells is None else cells
        self.moves = np.zeros((_N + 1, _N + 1)) if moves is None else moves

    def scores(self, i: np.ndarray, j: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The score of each segment under each kind; beyond the kind's bound: minus infinity."""
        out = self.cells[cells[:, 0]].copy()
        for c in range(1, cells.shape[1]):
            out += self.cells[cells[:, c]]
        out[(j - i)[:, None] > _BOUND] = -np.inf
        return out

    def best(self, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """The best labelling: (segment, kind) of its segments, by dynamic programming over the ends of segments."""
        none, moves = _N, self.moves
        reach = scores + (moves[:, :none] - moves[:, [none]]).max(axis=0) + (moves[:none] - moves[none]).max(axis=1)
        rows, kinds = np.nonzero(reach > 0)  # others lose to no segment, whatever stands beside them
        if not len(rows):
            return []
        order = np.lexsort((i[rows], j[rows]))
        into: dict[int, list] = {}
        for r, k in zip(rows[order].tolist(), kinds[order].tolist()):
            into.setdefault(int(j[r]), []).append((r, k))
        points = sorted({*into, *(int(i[r]) for r in rows)})
        free, back = (0.0, None), {}  # the best with no kind at the end; ways into a point: kind to (value, path)
        at_point: dict[int, tuple] = {}
        waiting: list = []
        for x in points:
            for value, path, k in waiting:  # those that ended before x move to no kind
                if value + moves[k, none] > free[0]:
                    free = (value + moves[k, none], path)
            waiting = []
            ends: dict[int, tuple] = {}
            for r, k in into.get(x, ()):
                before_free, before_ends = at_point[int(i[r])]
                value, path = before_free[0] + moves[none, k], before_free[1]
                for other, (v, p) in before_ends.items():
                    if v + moves[other, k] > value:
                        value, path = v + moves[other, k], p
                value += scores[r, k]
                if k not in ends or value > ends[k][0]:
                    ends[k] = (value, (r, k, path))
            at_point[x] = (free, ends)
            waiting = [(v, p, k) for k, (v, p) in ends.items()]
        for value, path, k in waiting:
            if value + moves[k, none] > free[0]:
                free = (value + moves[k, none], path)
        out, path = [], free[1]
        while path:
            out.append((path[0], path[1]))
            path = path[2]
        return out[::-1]

    def sums(self, n: int, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log of the sum over all labellings of ``n`` tokens, the chance of each (segment, kind), the expected moves."""
        none, moves = _N, self.moves
        lse = np.logaddexp.reduce
        into, out_of = ([[] for _ in range(n + 1)] for _ in range(2))
        for r, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            into[b].append(r), out_of[a].append(r)
        a_none, a_kind = np.full(n + 1, -np.inf), np.full((n + 1, none), -np.inf)
        enter = np.full((n + 1, none), -np.inf)
        a_none[0] = 0.0
        for x in range(n + 1):
            if x:
                a_none[x] = np.logaddexp(a_none[x - 1], lse(a_kind[x - 1] + moves[:none, none]))
            if into[x]:
                rows = into[x]
                a_kind[x] = lse(scores[rows] + enter[i[rows]], axis=0)
            enter[x] = np.logaddexp(a_none[x] + moves[none, :none], lse(a_kind[x][:, None] + moves[:none, :none], axis=0))
        b_none, b_kind, leave = np.full(n + 1, -np.inf), np.full((n + 1, none), -np.inf), np.full((n + 1, none), -np.inf)
        for x in range(n, -1, -1):
            ahead = b_none[x + 1] if x < n else 0.0
            if out_of[x]:
                rows = out_of[x]
                leave[x] = lse(scores[rows] + b_kind[j[rows]], axis=0)
            b_none[x] = np.logaddexp(ahead, lse(moves[none, :none] + leave[x]))
            b_kind[x] = np.logaddexp(moves[:none, none] + ahead, lse(moves[:none, :none] + leave[x][None, :], axis=1))
        total = np.logaddexp(a_none[n], lse(a_kind[n] + moves[:none, none]))
        with np.errstate(invalid="ignore"):
            chance = np.exp(enter[i] + scores + b_kind[j] - total) if len(i) else np.zeros((0, none))
            expected = np.zeros((none + 1, none + 1))
            expected[none, :none] = np.exp(a_none[:, None] + moves[none, :none] + leave - total).sum(axis=0)
            expected[:none, :none] = np.exp(a_kind[:, :, None] + moves[None, :none, :none] + leave[:, None, :] - total).sum(axis=0)
            ahead = np.append(b_none[1:], 0.0)
            expected[:none, none] = np.exp(a_kind + moves[:none, none] + ahead[:, None] - total).sum(axis=0)
        return float(total), chance, expected


def gold_moves(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The moves of a labelling of ``n`` tokens by spans (i, j, kind) in order; those from no kind to itself are left out."""
    out, at, last = np.zeros((_N + 1, _N + 1)), 0, _N
    for i, j, k in spans:
        if i > at and last != _N:
            out[last, _N] += 1
        out[last if i == at else _N, k] += 1
        at, last = j, k
    if last != _N:
        out[last, _N] += 1
    return out


def train(sentences: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.35) -> Field:
    """Gradient ascent (AdaGrad) on the log likelihood of the labellings, by forward and backward sums."""
    data = []
    for text, spans in sentences:
        t = Tokens([text])
        i, j, cells = t.segments()
        kinds = {(a, b): _FIELD.index(k) for k, a, b in spans}
        gold = np.zeros((len(i), _N))
        for r in range(len(i)):
            k = kinds.get((int(t.start[i[r]]), int(t.end[j[r] - 1])))
            if k is not None and j[r] - i[r] <= _BOUND[k]:
                gold[r, k] = 1
        held = sorted((int(i[r]), int(j[r]), int(gold[r].argmax())) for r in np.flatnonzero(gold.any(axis=1)))
        data.append((len(t.kind), i, j, cells, gold, gold_moves(len(t.kind), held)))
    model = Field()
    model.cells[0] = -4.0
    square, square_moves = np.full(model.cells.shape, 1e-3), np.full(model.moves.shape, 1e-3)
    for _ in range(epochs):
        for n, i, j, cells, gold, moved in data:
            if not len(i):
                continue
            _, chance, expected = model.sums(n, i, j, model.scores(i, j, cells))
            rest = gold - chance
            busy = np.flatnonzero(np.abs(rest).max(axis=1) > 1e-4)
            if len(busy):
                used, place = np.unique(cells[busy], return_inverse=True)
                grad = np.zeros((len(used), _N))
                np.add.at(grad, place.reshape(len(busy), -1), rest[busy][:, None, :])
                grad -= 1e-3 * model.cells[used]
                square[used] += grad * grad
                model.cells[used] += rate * grad / np.sqrt(square[used])
            grad = moved - expected - 1e-3 * model.moves
            grad[_N, _N] = 0
            square_moves += grad * grad
            model.moves += rate * grad / np.sqrt(square_moves)
    return model


def _sentences(seed: int, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Training sentences with their spans, by a seeded generator: shapes of several countries, and numbers that are none of them."""
    rng = random.Random(seed)
    syllables = ["an", "de", "er", "in", "lo", "mi", "ka", "tu", "re", "st", "on", "th", "ö", "é"]

    def word() -> str:
        made = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        return rng.choice([made, made, made, made.capitalize(), made.upper()])

    def num(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def shaped(shape: str) -> str:
        return "".join(rng.choice("0123456789") if c == "d" else c for c in shape)

    def card(k: int) -> str:
        d = rng.choice("3456") + num(k - 2)
        return d + next(str(c) for c in range(10) if luhn(d + str(c)))

    def account() -> str:
        body = rng.choice([num(18), num(16) , "".join(rng.choice("ABCDEFGH") for _ in range(4)) + num(14), num(20), num(12)])
        land = rng.choice(["DE", "FR", "GB", "ES", "NL", "IT", "CH"])
        made = next(t for c in range(2, 99) if _mod97(t := f"{land}{c:02d}{body}"))
        return rng.choice([made, " ".join(made[i : i + 4] for i in range(0, len(made), 4))])

    def address() -> str:
        o, c = rng.choice([(" ", " "), (" ", " "), (" ", " "), (" [", "] "), (" (", ") "), ("[", "]"), ("(", ")")])
        at, dot = rng.choice([("at", "dot"), ("AT", "DOT"), ("at", "dot")])
        return word().lower() + rng.choice(["", num(2), "." + word().lower()]) + o + at + c + (o + dot + c).join([word().lower() for _ in range(rng.choice([1, 1, 1, 1, 2, 2, 3, 4, 5, 6, 7]))] + [rng.choice(["com", "org", "net", "de"])])

    def secret() -> str:
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        return rng.choice(["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))), "".join(rng.choice(letters) for _ in range(rng.randint(26, 60)))])

    def password() -> str:
        return "".join(rng.choice("abcdefghkmnpqrstuvwxyz") for _ in range(rng.randint(4, 8))) + num(rng.randint(2, 4)) + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))

    phones = ["(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "0ddd-ddddddd", "0dd/ddddddd", "0ddd ddddddd", "0d dd dd dd dd", "0ddd/ddd ddd d", "00dd ddd ddd dd dd", "0dd dddd dddd", "(0dd) dddd dddd", "ddd dd dd dd", "0ddd dddd-dd"]
    makers = {
        "email": lambda: (rng.choice(["mail ", "contact ", "write to ", "", "", "", "reach me: "]), address()),
        "phone": lambda: (rng.choice(["call ", "phone: ", "tel. ", "fax ", "or ", "", "", "mobil "]), shaped(rng.choice(phones))),
        "ip": lambda: (rng.choice(["host ", "", "server "]), rng.choice(["[.]", "(dot)", "[dot]", " dot ", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))),
        "secret": lambda: (rng.choice(['token = "', "api_key=", "key = ", "secret: ", "", "", '"']), secret()) if rng.random() < 0.7 else (rng.choice(["password: ", "passwd = ", 'pwd="', "secret="]), password()),
        "card": lambda: (rng.choice(["card ", "visa ", "", "credit card no. "]), (lambda d: rng.choice([d, "-".join([d[:4], d[4:8], d[8:12], d[12:]]), " ".join([d[:4], d[4:10], d[10:]]), d[:4] + "." + d[4:8] + "." + d[8:12] + "." + d[12:]]))(card(rng.choice([15, 16, 16, 16])))),
        "account": lambda: (rng.choice(["iban ", "account: ", "konto ", ""]), account()),
    }

    def noise() -> str:
        unlike = lambda k: next(d for d in iter(lambda: num(k), None) if not luhn(d))
        return rng.choice([
            lambda: num(rng.randint(2, 12)), lambda: shaped("dddd-dd-dd"), lambda: shaped("dd/dd/dddd"), lambda: shaped("dd.dd.dddd"), lambda: shaped("dd:dd:dd"), lambda: shaped("d.dd.dd"), lambda: shaped("version d.d"),
            lambda: shaped("ddd ddd ddd"), lambda: shaped("dd,ddd.dd"), lambda: unlike(16), lambda: unlike(16) + " " + unlike(16), lambda: shaped("ddd-ddd"), lambda: shaped("dddd-dd-dd dd:dd:dd"), lambda: f"at {word()} dot", lambda: f"at {word()}",
            lambda: word() * 8, lambda: f"the {word()}-{word()}-{word()}-{word()}-{word()}-{word()}-{word()}", lambda: f"dot {word()}", lambda: shaped("(ddd)"), lambda: f"key: {word()} {word()}", lambda: f"token {word()}", lambda: shaped("d,ddd,ddd ddd"), lambda: shaped("ISBN ddd-d-dd-dddddd-d"),
            lambda: shaped("page ddd, line dd"), lambda: shaped("dddd/dd"), lambda: "999.300.256.1", lambda: shaped("dd dd dd"), lambda: " ".join(str(rng.randint(0, 60)) for _ in range(8)), lambda: shaped("dd.ddd.ddd.ddd"), lambda: word(),
        ])()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += "".join(word() + " " for _ in range(rng.randint(0, 5)))
            if rng.random() < 0.5:
                kind = rng.choice(list(makers))
                cue, made = makers[kind]()
                text += cue
                spans.append((kind, len(text), len(text) + len(made)))
                text += made + rng.choice([" ", ". ", ", ", '" ', "; ", ") ", "*** ", "!! ", "\n"])
            else:
                text += noise() + rng.choice([" ", ". ", ", ", "!! ", "\n"])
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def default_model(seed: int = 11, n: int = 450) -> Field:
    return train(_sentences(seed, n))


def decode(texts: list[str], model: Field, fixed: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """For each text, the spans of the best labelling among those that avoid its ``fixed`` spans."""
    tokens = Tokens(texts)
    i, j, cells = tokens.segments()
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not len(i):
        return out
    scores = model.scores(i, j, cells)
    none = _N
    loud = np.flatnonzero((scores + (model.moves[:, :none] - model.moves[:, [none]]).max(axis=0) + (model.moves[:none] - model.moves[none]).max(axis=1) > 0).any(axis=1))
    by_doc: dict[int, list[int]] = {}
    for r in loud.tolist():
        by_doc.setdefault(int(tokens.doc[i[r]]), []).append(r)
    for n, rows in by_doc.items():
        starts, reach = [], [0]  # of the fixed spans: starts in order, and the furthest end of those before
        for _, a, b in sorted(fixed[n], key=lambda s: s[1]):
            starts.append(a), reach.append(max(reach[-1], b))
        rows = np.array([r for r in rows if reach[bisect_left(starts, tokens.end[j[r] - 1])] <= tokens.start[i[r]]], np.int64)
        if len(rows):
            out[n] = [(_FIELD[k], int(tokens.start[i[rows[r]]]), int(tokens.end[j[rows[r]] - 1])) for r, k in model.best(i[rows], j[rows], scores[rows])]
    return out


def find_all(texts: list[str | None], model: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans, and all spans by kind as listed, then start, of each text. Null counts as empty."""
    whole = [t or "" for t in texts]
    base = [base_spans(t) for t in whole]
    order = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(b + more, key=lambda s: (order[s[0]], s[1])) if more else b) for b, more in zip(base, decode(whole, model, base))]


def find(text: str | None, model: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    return find_all([text], model)[0]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, model: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with counts of base spans, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans (the digest of an empty string). Spans are code points, end
    exclusive. Rows are searched alone: repeated rows agree, an empty table gives no rows. A very long text is
    searched whole by one task, whose memory follows its length. The added columns replace input columns of
    the same names.
    """

    def start():
        def step(column):
            counts = {k: [] for k in BASE_KINDS}
            digest, everything = [], []
            for base, spans in find_all(column.to_pylist(), model):
                kinds = [s[0] for s in base]
                for k in BASE_KINDS:
                    counts[k].append(kinds.count(k))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                everything.append(joined(spans))
            return [*(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digest, pa.string()), pa.array(everything, pa.string())]
        return step

    return append_columns(docs, text_col, start, [*(field(f"n_{k}", "long") for k in BASE_KINDS), field("base_sha256", "string"), field("spans", "string")], keep)


def redact(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one. Null stays null.

    All other columns stay, whatever their names; repeated rows stay repeated, and an empty table stays empty. A very
    long text is redacted whole by one task.
    """

    def clean(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def start():
        def step(column):
            texts = column.to_pylist()
            return [pa.array([clean(t, spans) for t, (_, spans) in zip(texts, find_all(texts, model))], pa.string())]
        return step

    order = docs.columns
    return append_columns(docs, text_col, start, [field(text_col, "string")]).select(*order)

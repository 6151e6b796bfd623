"""Quality rules: exact document statistics and monotone gradient-boosted trees (operator 7).

Statistics come from flat numpy passes over whole texts. The trees are trained on the driver on a
bounded sample of labelled rows (``max_labels``, a parameter), on histogram bins, with signs that
hold the score down where a statistic marks junk. A trained model is four node arrays that score
a whole matrix level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.batches import LINE_TABLE, SPACE_TABLE, append_columns, field, flat, groups, shingle_hashes, span_hashes, spans, window_hashes

#: Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Labelled rows used for training at most.
MAX_LABELS = 20_000

FEATURES = ["log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "short_line_ratio", "distinct_ratio", "letter_ratio"]
#: -1: the score never rises with the statistic; 1: never falls; 0: free.
MONOTONE = np.array([0, 0, -1, -1, -1, -1, -1, -1, 0, 0, 1])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?=@_{}[]~^\\")] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC3:] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Exact counts of each text and its feature matrix. Null counts as empty."""
    data, offsets = flat(column)
    counts, features = [], []
    for a, b in groups(offsets):
        c, f = _group(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        counts.append(c)
        features.append(f)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if not counts:
        return {n: np.empty(0, np.int64) for n in names}, np.empty((0, len(FEATURES)))
    return {n: np.concatenate([c[n] for c in counts]) for n in names}, np.concatenate(features)


def _twice(docs: np.ndarray, hashes: np.ndarray, second) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the items that their document holds twice or more, and of all but the first of each.

    Items of equal hash are told apart by a second one (``second(indices)``): 128 bits in all.
    """
    order = np.lexsort((hashes, docs))
    same = (hashes[order][1:] == hashes[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    maybe = np.zeros(len(order), bool)
    maybe[1:] |= same
    maybe[:-1] |= same
    maybe = np.sort(order[maybe])
    if not len(maybe):
        return maybe, maybe
    other = second(maybe)
    order = np.lexsort((other, hashes[maybe], docs[maybe]))
    of = maybe[order]
    same = (hashes[of][1:] == hashes[of][:-1]) & (docs[of][1:] == docs[of][:-1]) & (other[order][1:] == other[order][:-1])
    twice = np.zeros(len(of), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return of[twice], of[1:][same]


def _group(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    n = len(offsets) - 1
    starts, ends, docs = spans(data, offsets, SPACE_TABLE)
    words = span_hashes(data, starts, ends)
    n_words = np.bincount(docs, minlength=n).astype(np.int64)
    lead = (data & 0xC0) != 0x80
    word_chars = _sums(lead & ~SPACE_TABLE[data], offsets)
    n_symbols = _sums(_SYMBOL[data], offsets)

    # lines that hold a word and equal an earlier line of the text
    ls, le, ld = spans(data, offsets, LINE_TABLE)
    seen = np.concatenate([[0], np.cumsum(~SPACE_TABLE[data], dtype=np.int64)])
    full = seen[le] > seen[ls]
    ls, le, ld = ls[full], le[full], ld[full]
    n_lines = np.bincount(ld, minlength=n)
    _, again = _twice(ld, span_hashes(data, ls, le), lambda i: span_hashes(data, ls[i], le[i], 1))
    n_dup = np.bincount(ld[again], minlength=n)
    short = np.bincount(ld[(le - ls) < 30], minlength=n)

    # words inside a window of eight that the text holds twice or more
    repeat = np.zeros(n, np.int64)
    windows, wdocs = shingle_hashes(words, docs, WINDOW)
    if len(windows):
        whole = np.flatnonzero(docs[: len(words) - WINDOW + 1] == docs[WINDOW - 1 :])

        def second(i):
            at = whole[i][:, None] + np.arange(WINDOW)
            used, place = np.unique(at, return_inverse=True)
            return window_hashes(span_hashes(data, starts[used], ends[used], 1)[place.reshape(at.shape)])

        twice = _twice(wdocs, windows, second)[0]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, whole[twice], 1)
        np.add.at(change, whole[twice] + WINDOW, -1)
        repeat = np.bincount(docs[np.cumsum(change)[:-1] > 0], minlength=n).astype(np.int64)
    order = np.lexsort((words, docs))
    new = np.ones(len(words), bool)
    if len(words) > 1:
        new[1:] = (words[order][1:] != words[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    distinct_words = np.bincount(docs[order][new], minlength=n) if len(words) else np.zeros(n)

    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    f = np.stack([
        np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / np.maximum(n_lines, 1), repeat / w,
        _sums(_UPPER[data], offsets) / c, _sums(_DIGIT[data], offsets) / c, _sums(_MARK[data], offsets) / c,
        short / np.maximum(n_lines, 1), distinct_words / w, _sums(_LETTER[data], offsets) / c,
    ], axis=1)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup.astype(np.int64), "n_repeat_words": repeat}, f


@dataclass
class Trees:
    """Flattened trees: node ``i`` sends ``x[feature] <= threshold`` to ``left``, others to ``left + 1``; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                leaf = self.left[node] == node
                node = np.where(leaf, node, self.left[node] + (x[rows, self.feature[node]] > self.threshold[node]))
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss. With no rows or one class: the prior alone."""
    feature, threshold, left, value, roots = [], [], [], [], []
    mean = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    base = float(np.log(mean / (1 - mean)))
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            root = len(feature)
            roots.append(root)
            feature.append(0), threshold.append(0.0), left.append(root), value.append(0.0)
            queue = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
            while queue:
                node, rows, level, low, high = queue.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = rate * float(np.clip(g / (h + ridge), low, high))
                best = (1e-3, None)
                if level < depth and len(rows) >= 20:
                    for j in range(x.shape[1]):
                        m = len(cuts[j]) + 1
                        gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], m))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], m))[:-1]
                        nl = np.cumsum(np.bincount(binned[rows, j], minlength=m))[:-1]
                        wl, wr = gl / (hl + ridge), (g - gl) / (h - hl + ridge)
                        gain = gl * wl + (g - gl) * wr - g * g / (h + ridge)
                        ok = (nl >= 5) & (len(rows) - nl >= 5)
                        if monotone[j]:
                            ok &= monotone[j] * (wr - wl) >= 0
                        if ok.any():
                            k = int(np.argmax(np.where(ok, gain, -np.inf)))
                            if gain[k] > best[0]:
                                best = (gain[k], (j, k, wl[k], wr[k]))
                if best[1]:
                    j, k, wl, wr = best[1]
                    l = len(feature)
                    feature[node], threshold[node], left[node] = j, float(cuts[j][k]), l
                    middle = float(np.clip((np.clip(wl, low, high) + np.clip(wr, low, high)) / 2, low, high))
                    for side in (0, 1):
                        feature.append(0), threshold.append(0.0), left.append(l + side), value.append(0.0)
                        a, b = low, high
                        if monotone[j]:  # bounds of everything below keep the order
                            a, b = (low, middle) if (monotone[j] > 0) == (side == 0) else (middle, high)
                        chosen = (binned[rows, j] > k) == bool(side)
                        queue.append((l + side, rows[chosen], level + 1, a, b))
                else:
                    margin[rows] += value[node]
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), depth, base)


def labelled_features(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_labels`` labelled rows, chosen by a hash of the id.

    The chosen labels go to the texts (their number is bounded), so no text is shuffled. An id with
    several texts gives one row a label, the least features.
    """
    chosen = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("__label_id"), F.col("quality").cast("int").alias("__quality")).orderBy(F.xxhash64("__label_id"), "__quality").limit(max_labels)
    texts = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__body")).join(F.broadcast(chosen.distinct()), F.col("__id") == F.col("__label_id"))

    def start():
        def step(column):
            x = statistics(column)[1]
            return [pa.array(list(x), pa.list_(pa.float64()))]
        return step

    rows = append_columns(texts, "__body", start, [field("__x", "array<double>")], keep=["__id", "__quality"]).groupBy("__id", "__quality").agg(F.min("__x").alias("__x")).toArrow()
    if not rows.num_rows:
        return np.empty((0, len(FEATURES))), np.empty(0)
    rows = rows.sort_by([("__id", "ascending"), ("__quality", "ascending")])
    return np.array(rows.column("__x").to_pylist()), rows.column("__quality").to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, keep_share: float = 0.995, **options) -> tuple[Trees, float]:
    """Trees, and the score below which a document goes: the least that keeps ``keep_share`` of good rows."""
    x, y = labelled_features(docs, labels, **options)
    trees = train(x, y)
    good = trees.score(x[y == 1]) if (y == 1).any() else np.empty(0)
    cut = min(0.5, float(np.quantile(good, 1 - keep_share)) - 1e-9) if len(good) else 0.0
    return trees, cut


def quality_rules(docs: DataFrame, model: tuple[Trees, float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with exact counts, ``base_failed``, ``quality_score`` and ``kept``.

    Null and empty texts have no words and fail. Rows are scored alone: repeated rows get equal
    verdicts, ties with the cut are kept, an empty table gives no rows. A very long text is
    counted whole by one task, whose memory follows its length. The added columns replace input columns of the same names.
    """
    trees, cut = model

    def start():
        def step(column):
            counts, x = statistics(column)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            score = trees.score(x)
            return [*(pa.array(counts[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(score), pa.array(~failed & (score >= cut))]
        return step

    fields = [field(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [field("base_failed", "boolean"), field("quality_score", "double"), field("kept", "boolean")]
    return append_columns(docs, text_col, start, fields, keep)

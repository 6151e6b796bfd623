"""Hierarchical language identification (operator 9).

A linear classifier on hashed byte n-grams first picks the language family; within the family,
one-versus-one linear support vector machines vote, ties going to the larger margin. Training
takes at most ``per_language`` documents of each language (a parameter), chosen by a hash of id
and text; scoring reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.llm.batches import LOWER_TABLE, append_columns, field, flat, groups

BINS = 4096
#: Training rows of a language, and languages learned, at most.
PER_LANGUAGE, LANGUAGES = 1000, 200
#: Families of common languages; a language not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic",
}
_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[:0x41] = _NOT_LETTER[0x5B:0x61] = _NOT_LETTER[0x7B:0x80] = True


def histograms(column: pa.Array) -> np.ndarray:
    """Square-root n-gram frequencies of each text, one row a text, unit length (0 for texts without letters)."""
    data, offsets = flat(column)
    out = np.zeros((len(offsets) - 1, BINS), np.float32)
    for a, b in groups(offsets):
        for c in range(a, b, 256):  # bounds the dense rows
            d = min(b, c + 256)
            out[c:d] = _rows(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c])
    return out


def _rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    x = np.where(_NOT_LETTER[data], 0x20, LOWER_TABLE[data]).astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    total = np.zeros(n * BINS)
    for size in (1, 2, 3):
        if len(x) < size:
            break
        code = np.full(len(x) - size + 1, size, np.uint32)
        for j in range(size):
            code = code * np.uint32(0x01000193) + x[j : len(x) - size + 1 + j]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 12)
        inside = (doc[: len(code)] == doc[size - 1 :]) & (x[: len(code)] != 0x20) if size == 1 else doc[: len(code)] == doc[size - 1 :]
        total += np.bincount(doc[: len(code)][inside] * BINS + code[inside], minlength=n * BINS)
    rows = np.sqrt(total.reshape(n, BINS))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.maximum(norm, 1e-9)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 1e-4) -> np.ndarray:
    """Weights (last: bias) of a linear machine with squared hinge loss, by accelerated gradient; y in -1, 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    for _ in range(steps):
        look = w + np.float32(0.9) * v
        slack = np.maximum(0, 1 - y * (x @ look))
        grad = np.float32(ridge) * look - 2 * ((weight * y * slack) @ x)
        v = np.float32(0.9) * v - np.float32(0.2) * grad
        w = w + v
    return w


@dataclass
class Model:
    """``families``: family, weights, languages; ``pairs``: (language, language) to weights."""

    languages: list[str]
    families: list[tuple[str, np.ndarray, list[str]]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score (0 to 1) of each row."""
        n = len(x)
        x = np.hstack([x, np.ones((n, 1), np.float32)])
        margins = np.stack([x @ w for _, w, _ in self.families], axis=1) if self.families else np.zeros((n, 0))
        names = np.full(n, "und", object)
        score = np.zeros(n)
        if not self.families:
            return names, score
        chosen = margins.argmax(axis=1)
        top = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        family_score = top.max(axis=1) / top.sum(axis=1)
        for f, (_, _, languages) in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(languages)))
            sums = np.zeros((len(rows), len(languages)))
            for i, j in combinations(range(len(languages)), 2):
                m = x[rows] @ self.pairs[languages[i], languages[j]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
            best = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1)
            names[rows] = np.array(languages, object)[best]
            own = sums[np.arange(len(rows)), best] / max(1, len(languages) - 1)
            score[rows] = family_score[rows] * (1 / (1 + np.exp(-4 * own)) if len(languages) > 1 else 1.0)
        return names, score


def train(x: np.ndarray, lang: np.ndarray) -> Model:
    languages = sorted(set(lang))
    groups_: dict[str, list[str]] = {}
    for l in languages:
        groups_.setdefault(FAMILIES.get(l, l), []).append(l)
    family_of = np.array([FAMILIES.get(l, l) for l in lang], object)
    families = [(f, _svm(x, np.where(family_of == f, 1.0, -1.0)) if len(groups_) > 1 else np.zeros(x.shape[1] + 1), ls) for f, ls in sorted(groups_.items())]
    pairs = {}
    for _, _, ls in families:
        for i, j in combinations(ls, 2):
            rows = np.isin(lang, [i, j])
            pairs[i, j] = _svm(x[rows], np.where(lang[rows] == i, 1.0, -1.0))
    return Model(languages, families, pairs)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> Model:
    """Train on at most about ``per_language`` labelled texts of each of the ``languages`` most frequent languages.

    Rows with null text or language teach nothing; equal rows teach once. The sample is drawn by a hash of id and text.
    """
    rows = docs.where(docs[text_col].isNotNull() & docs[lang_col].isNotNull()).select(docs[id_col].alias("__id"), docs[lang_col].alias("__lang"), docs[text_col].alias("__body"))
    counts = rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "__lang").limit(languages)
    keyed = rows.withColumn("__key", F.xxhash64(F.lit(17), "__id", "__body"))
    draw = F.pmod(F.col("__key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = keyed.join(F.broadcast(counts), "__lang").where(draw < per_language / F.col("__n"))  # one row a language

    def start():
        def step(column):
            h = histograms(column)
            return [pa.array([np.flatnonzero(r).astype(np.int16) for r in h], pa.list_(pa.int16())), pa.array([r[r != 0] for r in h], pa.list_(pa.float32()))]
        return step

    fields = [T.StructField("__at", T.ArrayType(T.ShortType())), T.StructField("__x", T.ArrayType(T.FloatType()))]
    made = append_columns(chosen, "__body", start, fields, keep=["__lang", "__key"])
    got = made.groupBy("__lang", "__key").agg(F.min(F.struct("__at", "__x")).alias("v")).select("__lang", "__key", "v.*").toArrow()
    if not got.num_rows:
        return Model([], [], {})
    got = got.sort_by([("__lang", "ascending"), ("__key", "ascending")]).combine_chunks()
    x = np.zeros((got.num_rows, BINS), np.float32)
    for i, (at, v) in enumerate(zip(got.column("__at"), got.column("__x"))):
        x[i, at.values.to_numpy()] = v.values.to_numpy()
    return train(x, np.array(got.column("__lang").to_pylist(), object))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is read.

    Null text, or text without a letter: ``und`` with score 0. A model that learned from no rows
    says ``und`` to all. Rows are scored alone, so repeated rows agree. Ties of votes go to the
    larger sum of margins, then to the first language by name. An empty table gives no rows. A very long text is
    counted whole by one task. The added columns replace input columns of the same names.
    """

    def start():
        def step(column):
            names, score = model.predict(histograms(column))
            texts = column.to_pylist()
            none = np.array([not (t and (t.isalpha() or any(map(str.isalpha, t)))) for t in texts], bool)
            names[none], score[none] = "und", 0.0
            return [pa.array(names.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))]
        return step

    return append_columns(docs, text_col, start, [field("lang_pred", "string"), field("score", "double")], keep)

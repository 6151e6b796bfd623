"""Importance resampling towards a target distribution (operator 13).

Texts become hashed word features by a byte automaton (``words``). Feature counts of the corpus and of the target texts,
bucket by bucket, give each bucket a gain; a document's weight is the mean gain of its features. Weights with Gumbel
noise drawn from a hash of the id make the highest scores a sample without replacement. Two passes read the texts and
neither shuffles them: only bucket counts (at most one row a bucket and task) and narrow rows of scores move. Ranks come from counts by
score and a numbering within each score, so no task orders all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from palimpsest.llm.batches import Buckets, append_columns, field, fresh
from palimpsest.llm.words import crc32_words, word_pieces
from palimpsest.runtime import Scratch, prepare

#: Hash buckets of features.
BUCKETS = 10_000
#: Words that a document needs to be drawn, and percent of such documents that are drawn.
LEAST_WORDS, PERCENT = 20, 10
#: Rows over which equal scores are numbered in parts by id (one score in 2,500 of all rows at most is the densest).
PART_ROWS = 1 << 31

Bounds = tuple[int, int]


def features(column: pa.Array, buckets: int = BUCKETS, runs: Bounds = (1, 1)):
    """Piece by piece, the bucket and row of each feature, a run of ``runs[0]`` to ``runs[1]`` consecutive words joined by one space; and each row's words.

    Runs of several words go on over the pieces of a very long text.
    """
    low, high = runs
    behind: list[tuple[int, bytes]] = []  # the last words of the row so far
    for data, starts, ends, rows in word_pieces(column):
        if high == 1:
            yield crc32_words(data, starts, ends) % np.uint32(buckets), rows, rows
            continue
        words = [(r, data[a:b].tobytes()) for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist())]
        n, words = len(behind), behind + words
        made, owner = [], []
        for i in range(n, len(words)):
            row = words[i][0]
            for k in range(low, high + 1):
                j = i - k + 1
                if j < 0 or words[j][0] != row:
                    break
                made.append(b" ".join(w for _, w in words[j : i + 1]))
                owner.append(row)
        ends_ = np.cumsum([len(x) for x in made], dtype=np.int64)
        flat_ = np.frombuffer(b"".join(made), np.uint8)
        yield crc32_words(flat_, np.concatenate([[0], ends_[:-1]]).astype(np.int64), ends_) % np.uint32(buckets), np.array(owner, np.int64), rows
        behind = [w for w in words[max(0, len(words) - high + 1) :] if w[0] == words[-1][0]] if words else []


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, runs: Bounds = (1, 1), least_words: int = LEAST_WORDS) -> tuple[np.ndarray, int]:
    """Features in each bucket over all rows, and the rows with at least ``least_words`` words."""
    prepare(docs.sparkSession)

    def run(batches):
        held, long_ = np.zeros(buckets, np.int64), 0
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            for bucket, _, rows in features(batch.column(0), buckets, runs):
                held += np.bincount(bucket, minlength=buckets)
                n_words += np.bincount(rows, minlength=batch.num_rows)
            long_ += int((n_words >= least_words).sum())
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *met.tolist()], pa.int64()), pa.array([long_, *held[met].tolist()], pa.int64())], names=["bucket", "n"])

    rows = docs.select(docs[text_col].cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    counts, long_ = np.zeros(buckets, np.int64), 0
    for r in rows:
        if r["bucket"] < 0:
            long_ = r["n"]
        else:
            counts[r["bucket"]] = r["n"]
    return counts, long_


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: 1000 times the log ratio of its add-one shares in the target and in the source, floored."""
    n = len(source)
    s, t, all_s, all_t = source.astype(float), target.astype(float), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text", keep: list[str] | None = None, runs: Bounds = (1, 1)) -> DataFrame:
    """Columns (all, or ``keep``) with ``n_words``, ``n_features`` and ``weight``, the floored mean gain of the features (none: 0). Very long texts are read piece by piece."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def start():
        table = sent.value

        def step(column):
            n, words, total = (np.zeros(len(column), np.int64) for _ in range(3))
            for bucket, rows, of_words in features(column, len(table), runs):
                n += np.bincount(rows, minlength=len(column))
                words += np.bincount(of_words, minlength=len(column))
                np.add.at(total, rows, table[bucket])
            return [pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]

        return step

    return append_columns(docs, text_col, start, [field("n_words", "long"), field("n_features", "long"), field("weight", "long")], keep=keep)


def noise(id_: str, seed: int):
    """1000 times a standard Gumbel number, floored, from the SHA-256 of ``seed:id`` (a null id: ``seed:``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _numbered(top: DataFrame, total: int, cells: DataFrame) -> DataFrame:
    """Ranks of the rows of ``cells`` (score, part and the rows before it): rows before, and the place within."""
    order = Window.partitionBy("score", "part").orderBy(F.asc_nulls_last("doc_id"))
    placed = top.join(cells, ["score", "part"]).withColumn("rank", (F.col("before") + F.row_number().over(order)).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= total, F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least_words: int = LEAST_WORDS, buckets: int = BUCKETS, runs: Bounds = (1, 1), part_rows: int = PART_ROWS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` per row; ``rank`` (from 1, highest score first, ties to the smaller id, null ids last) is null for rows that are not drawn.

    Drawn are floor(percent * N / 100) rows of the N with at least ``least_words`` words. Null texts have none. Repeated rows
    are rows of their own, with equal scores and ranks side by side. An empty table gives no rows; with an empty target every
    document's weight measures rarity alone. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    source, eligible = bucket_counts(docs, "text", buckets, runs, least_words)
    wanted, _ = bucket_counts(target, target_col, buckets, runs)
    total = percent * eligible // 100
    made = weighted(docs, gains(source, wanted), keep=["doc_id"], runs=runs)
    rows = scratch.stored(made.withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    by_id = able.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"))
    part = Buckets.of(by_id, "doc_id", part_rows) if eligible > part_rows else None
    cell = F.lit(0) if part is None else part(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.lit(0).cast("long"))
    able = able.withColumn("part", cell.cast("int"))
    # a row a score and part: scores are whole numbers of a narrow range
    cells = able.groupBy("score", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score"), "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = scratch.stored(cells.withColumn("before", before).where(F.col("before") < total).select("score", "part", "before"), "cells")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    drawn = _numbered(able, total, cells).select(*columns)
    rest = able.join(cells, ["score", "part"], "left_anti").unionByName(rows.where(F.col("n_words") < least_words), allowMissingColumns=True)
    result = Scratch(docs.sparkSession).stored(drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(*columns)), "resampled")
    scratch.drop()
    return result

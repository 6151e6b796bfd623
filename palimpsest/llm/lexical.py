"""Ranked lexical search: impact-ordered, score at a time (operator 11).

``index`` makes a table of document blocks of bounded size, one row each: the documents' ids and lengths, and for
every term its postings (document, occurrences). ``search`` reads that table alone. A posting's impact is what it
adds to a score; in each block, a term's postings are grouped by exact impact. The groups of all of an item's terms
are processed from the highest impact down. What a term can still add is its next group's impact, so processing ends
when these bounds, added up, prove that no document but the candidates at hand can be among the k best; the
candidates' scores are then completed from their postings. A task carries each item's kth best score from block to
block, which ends later blocks sooner, and returns k rows an item at most. Items are taken in blocks too, so neither
the documents nor the items need fit anywhere whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from palimpsest.llm.batches import span_hashes
from palimpsest.llm.words import word_pieces
from palimpsest.runtime import Scratch, prepare

#: Bytes of text of a block of documents (one document at least).
BLOCK_BYTES = 8 << 20
#: Items and bytes of their texts that are searched in one pass.
ITEMS, ITEM_BYTES = 4096, 8 << 20
#: Postings of the first step down the impacts; each further step takes twice as many.
STEP = 4096
#: Parts that an item's results are merged in before they meet.
MERGE_PARTS = 64
#: Blocks of a row group of the index: writers and readers hold a row group whole, and Parquet looks at its bytes only every hundred rows.
GROUP_BLOCKS = 1

_INTS = T.ArrayType(T.IntegerType())


def _postings(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and term, row and occurrences of each posting, ordered by term and row."""
    keys, rows, counts, words = [], [], [], {}
    for data, starts, ends, docs in word_pieces(column):
        h, h2 = (span_hashes(data, starts, ends, lane) for lane in (0, 1))
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if not (h2 == h2[first][inverse]).all():  # two words of one 64-bit hash: tell them apart by 128 bits
            _, first, inverse = np.unique(np.stack([h, h2], axis=1), axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
        number = np.array([words.setdefault(data[a:b].tobytes(), len(words)) for a, b in zip(starts[first].tolist(), ends[first].tolist())], np.int64)
        pairs, n = np.unique(number[inverse] << 32 | docs, return_counts=True)
        keys.append(pairs)
        counts.append(n)
    if not keys:
        return [], *(np.empty(0, np.int64) for _ in range(3))
    pairs, counts = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > 1:  # a term of a row may stand in several pieces
        pairs, inverse = np.unique(pairs, return_inverse=True)
        counts = np.bincount(inverse, weights=counts).astype(np.int64)
    return list(words), pairs >> 32, pairs & 0xFFFFFFFF, counts


def _block(ids: pa.Array, column: pa.Array, names: list[str]) -> pa.RecordBatch | None:
    terms, term, row, n = _postings(column)
    if not terms:
        return None
    lengths = np.bincount(row, weights=n, minlength=len(ids)).astype(np.int64)
    has = np.flatnonzero(lengths)
    place = np.cumsum(lengths > 0) - 1
    lists = [
        ids.take(pa.array(has)), pa.array(lengths[has], pa.int64()), pa.array([t.decode() for t in terms], pa.string()),
        pa.array(np.searchsorted(term, np.arange(len(terms) + 1)), pa.int32()), pa.array(place[row], pa.int32()), pa.array(n, pa.int32()),
    ]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.RecordBatch.from_arrays([*columns, pa.array([len(has)], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], names=names)


def index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the index of all documents to ``path`` and read it back: a row a block, with ``ids, lengths, terms, starts, rows, counts, n_docs, n_terms``.

    Documents without a term (null and empty ones too) are in no block. Repeated rows and ids are documents of
    their own. A very long text is a block alone, its words found piece by piece. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("starts", _INTS), T.StructField("rows", _INTS), T.StructField("counts", _INTS), T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()),
    ])
    names = schema.fieldNames()

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def made():
            if held:
                table = pa.Table.from_batches(held)
                out = _block(table.column(0).combine_chunks(), table.column(1).combine_chunks(), names)
                if out is not None:
                    yield out

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            a = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > block_bytes:
                    held.append(batch.slice(a, i - a))
                    yield from made()
                    held, size, a = [], 0, i
                size += n
            held.append(batch.slice(a))
        yield from made()

    made = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)
    made.write.option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for data, starts, ends, _ in word_pieces(pa.array([text], pa.string())):
        found.update(data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist()))
    return found


def _item_blocks(items: DataFrame, item_col: str, text_col: str):
    """Items with terms, block by block: their ids and the counts of their terms."""
    ids, wanted, size = [], [], 0
    for r in items.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if found := _counts(r["t"]):
            ids.append(r["i"])
            wanted.append(found)
            size += len(r["t"])
        if len(ids) >= ITEMS or size >= ITEM_BYTES:
            yield ids, wanted
            ids, wanted, size = [], [], 0
    if ids:
        yield ids, wanted


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class _Block:
    """A block's postings of the items' terms, grouped by exact impact, highest first within a term."""

    def __init__(self, row: dict, terms: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int, b: int, scale: int):
        held = pc.index_in(terms, value_set=row["terms"].values)
        asked = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
        at = held.take(pa.array(asked)).to_numpy(zero_copy_only=False).astype(np.int64)
        first = row["starts"].values.to_numpy()
        begin, n = first[at].astype(np.int64), (first[at + 1] - first[at]).astype(np.int64)
        post = _ranges(begin, n)
        lengths = row["lengths"].values.to_numpy()
        m = 100 - b + (b * lengths * n_docs) // n_terms
        self.docs, count = row["rows"].values.to_numpy()[post].astype(np.int64), row["counts"].values.to_numpy()[post].astype(np.int64)
        self.width, term = len(lengths), np.repeat(asked, n)
        self.impact = weights[term] * ((1_000_000_000 * count) // (1000 * count + scale * m[self.docs]))
        self.key = term * self.width + self.docs  # ascending
        order = np.lexsort((-self.impact, term))
        self.ordered = self.docs[order]
        t, x = term[order], self.impact[order]
        fresh = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])])) if len(t) else np.empty(0, np.int64)
        self.g_impact, self.g_start, self.g_n = x[fresh], fresh, np.diff(np.append(fresh, len(t)))
        self.of_term = np.searchsorted(t[fresh], np.arange(len(weights) + 1))

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that hold the block's ``k`` best, ties included, as far as they reach ``floor``."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        begin, n = self.of_term[terms], self.of_term[terms + 1] - self.of_term[terms]
        terms, times, begin, n = (v[n > 0] for v in (terms, times, begin, n))
        if not len(terms) or int((times * self.g_impact[begin]).sum()) < max(floor, 1):
            return none
        group, owner = _ranges(begin, n), np.repeat(np.arange(len(terms)), n)
        value = self.g_impact[group] * times[owner]
        order = np.argsort(-value, kind="stable")  # a term's groups stay in their order
        group, owner, value = group[order], owner[order], value[order]
        reach = np.cumsum(self.g_n[group])
        score, done, step = np.zeros(self.width, np.int64), 0, STEP
        taken = np.zeros(len(terms), np.int64)
        while True:
            upto = min(int(np.searchsorted(reach, (reach[done - 1] if done else 0) + step)) + 1, len(group))
            part = slice(done, upto)
            np.add.at(score, self.ordered[_ranges(self.g_start[group[part]], self.g_n[group[part]])], np.repeat(value[part], self.g_n[group[part]]))
            taken += np.bincount(owner[part], minlength=len(terms))
            done, step = upto, step * 2
            kth = max(floor, 1, int(np.partition(score, -k)[-k]) if self.width >= k else 0)
            if done == len(group):
                found = np.flatnonzero(score >= kth)
                return found, score[found]
            left = taken < n
            rest = int((self.g_impact[(begin + taken)[left]] * times[left]).sum())  # what any document can still gain at most
            if rest < kth:  # no document unseen so far can reach the kth
                found = np.flatnonzero(score + rest >= kth)
                break
        # complete the candidates' scores from all their postings
        asked = (terms[:, None] * self.width + found).ravel()
        at = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
        gain = np.where(self.key[at] == asked, self.impact[at], 0).reshape(len(terms), -1)
        score = (gain * times[:, None]).sum(axis=0)
        kth = max(floor, 1, int(np.partition(score, -k)[-k]) if len(score) >= k else 0)
        return found[score >= kth], score[score >= kth]


def search(index_: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", b: int = 75, scale: int = 8) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0, equal scores by ascending id (null ids last).

    Scores are whole numbers, as the task words them. Each row of ``items`` is an item of its own, so a repeated one
    has its ranks twice; an item without terms (null, empty) has none, as has any item over an empty index.
    """
    spark = index_.sparkSession
    prepare(spark)
    kind, item_kind = index_.schema["ids"].dataType.elementType, items.schema[item_col].dataType
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("item_id", item_kind), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    total = index_.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = total["n"], total["l"]
    result = None
    for ids, wanted in _item_blocks(items, item_col, text_col) if n_docs else []:
        names = sorted({t for w in wanted for t in w})
        number = {t: i for i, t in enumerate(names)}
        # bounded by ITEM_BYTES
        sent = spark.sparkContext.broadcast((ids, names, [(np.array([number[t] for t in w]), np.array(list(w.values()))) for w in wanted]))

        def frequencies(batches, sent=sent):
            terms = pa.array(sent.value[1], pa.string())
            df = np.zeros(len(terms), np.int64)
            for batch in batches:
                for row in range(batch.num_rows):
                    held = pc.index_in(terms, value_set=batch.column(0)[row].values)
                    asked = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
                    at = held.take(pa.array(asked)).to_numpy(zero_copy_only=False).astype(np.int64)
                    df[asked] += np.diff(batch.column(1)[row].values.to_numpy())[at]
            met = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], names=["term", "df"])

        counted = index_.select("terms", "starts").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # the items' terms at most
        weights = np.zeros(len(names), np.int64)
        for r in counted:
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        known = spark.sparkContext.broadcast(weights)

        def run(batches, sent=sent, known=known):
            ids, names, wanted = sent.value
            terms = pa.array(names, pa.string())
            kept: list[list[tuple]] = [[] for _ in ids]
            floors = [0] * len(ids)
            for batch in batches:
                for row in batch.to_struct_array():
                    block = _Block(row, terms, known.value, n_docs, n_terms, b, scale)
                    for i, (own, times) in enumerate(wanted):
                        found, score = block.best(own, times, k, floors[i])
                        if len(found):
                            at = row["ids"].values.take(pa.array(found)).to_pylist()
                            kept[i] = sorted(kept[i] + [(-s, d is None, d) for s, d in zip(score.tolist(), at)], key=lambda r: (*r[:2], 0 if r[1] else r[2]))[:k]
                            if len(kept[i]) == k:
                                floors[i] = -kept[i][-1][0]
            rows = [(i, ids[i], d, -s) for i, own in enumerate(kept) for s, _, d in own]
            for a in range(0, len(rows), 10_000):
                part = list(zip(*rows[a : a + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(part, arrow)], names=schema.fieldNames())

        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(f.dataType) for f in schema]
        rows = index_.select("ids", "lengths", "terms", "starts", "rows", "counts").mapInArrow(run, schema)
        best = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))  # tasks return k rows an item each
        few = part.withColumn("rank", F.row_number().over(Window.partitionBy("place", "part").orderBy(*best))).where(F.col("rank") <= k)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*best))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.unionByName(ranked)
    if result is None:
        result = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())]))
    return result


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index all of ``docs`` and search it for each of ``items``; see ``index`` and ``search``."""
    scratch = Scratch(docs.sparkSession)
    found = search(index(docs, scratch.path("postings")), items, k)
    result = Scratch(docs.sparkSession).stored(found, "ranked")  # the index is not needed any more
    scratch.drop()
    return result

"""Hashed maximum-entropy language model with class-factored softmax (operator 1).

Words are counted over the whole training corpus. The whole vocabulary is factored into classes
within classes of ``WAYS`` each: the frequent words by equal shares of their mass, so a word of
share p lies about log16(1/p) classes deep; all rarer words behind one class, by the digits of their
hash, as deep as their number asks for. Each choice of a class is a softmax over hashed n-gram and
skip features (the word before, the one before that, the last very frequent word within a reach,
the pair before), started at the counts' shares. At the end of the digits a rare word has its add-one share, as does
one unknown word, so the model is a distribution. The hashed tables have a row for about
``TOKENS`` tokens, up to 2^18 rows a feature (what a task holds and sends); from there on more text fills
them better. A task learns from ``TASK_TOKENS`` tokens a row or more, so that updates are in proportion to the texts. Each task
runs AdaGrad over the documents it reads from the common start; each table row is averaged over the
tasks that moved it, by how often they did. Scoring is numpy over sparse feature rows. The counts of
the ``known`` most frequent words travel with the code (a bound, not a cap): rarer words get theirs
by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field as made

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.batches import LOWER_TABLE, SPACE_TABLE, append_columns, field, flat, groups, mix, span_hashes, spans
from palimpsest.runtime import prepare, stored

#: Classes that a softmax chooses from.
WAYS = 16
#: Frequent words whose counts are sent to every task.
KNOWN = 1 << 17
#: Words that contexts tell apart (others: 256 groups), and very frequent ones that a skip may look back to.
CONTEXT, ANCHORS = 4096, 128
#: Tokens that a skip looks back at most, and tokens whose choices are laid out at a time.
LOOK, PIECE = 32, 1 << 15
#: Choices worked on at a time: 256 KB, which stay in a core's cache.
NEAR = 1 << 12
#: Bits of a feature's table: least, most (four tables of the most: 67 MB a copy).
BITS = 10, 18
#: Tokens for each row of a table, in all and in one task.
TOKENS, TASK_TOKENS = 128, 16
#: The end token's stand-in among word hashes.
END = np.uint64(0x5EED0FE11D)
FEATURES, FIRST_BATCH, MINIBATCH, RATE = 4, 512, 1 << 14, 0.2
#: Blocks of the parameters, and tasks whose updates are added at a time.
BLOCKS, FAN = 32, 64
#: Levels of hash digits of rare words at most.
DIGITS = 4


def tokens(column: pa.Array):
    """Per group of texts: first row, rows, token hashes (each text's words, then the end), token rows, and the second hash lane of chosen tokens."""
    data, offsets = flat(column)
    for a, b in groups(offsets):
        part, offs = LOWER_TABLE[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, docs = spans(part, offs, SPACE_TABLE)
        hashes = span_hashes(part, starts, ends)
        n = np.bincount(docs, minlength=b - a)
        place = np.arange(len(hashes)) + docs
        out = np.full(len(hashes) + b - a, END)
        out[place] = hashes

        def second(at: np.ndarray, part=part, starts=starts, ends=ends, place=place, size=len(out)) -> np.ndarray:
            word = np.full(size, -1)
            word[place] = np.arange(len(place))
            chosen, lane = word[at], np.full(len(at), END)
            lane[chosen >= 0] = span_hashes(part, starts[chosen[chosen >= 0]], ends[chosen[chosen >= 0]], 1)
            return lane

        yield a, b - a, out, np.repeat(np.arange(b - a), n + 1), second


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``word, check`` (128 bits of hash) and ``n`` over all texts; each task adds up its own first, by the first 64 bits."""
    prepare(docs.sparkSession)

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            words, checks, counts = (np.concatenate(c) for c in zip(*kept))
            order = np.argsort(words, kind="stable")
            words = words[order]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            return words[first], checks[order][first], np.add.reduceat(counts[order], first)

        def row(k):
            return pa.RecordBatch.from_arrays([pa.array(k[0].view(np.int64)), pa.array(k[1].view(np.int64)), pa.array(k[2])], names=["word", "check", "n"])

        for batch in batches:
            for *_, hashes, _, second in tokens(batch.column(0)):
                words, first, n = np.unique(hashes, return_index=True, return_counts=True)
                kept.append((words, second(first), n.astype(np.int64)))
                size += len(words)
                if size > 1_500_000:  # bounds the task's memory
                    kept = [merged()]
                    size = len(kept[0][0])
                    if size > 1_000_000:
                        yield row(kept[0])
                        kept, size = [], 0
        if kept:
            yield row(merged())

    return docs.select(docs[text_col].cast("string")).mapInArrow(run, "word long, check long, n long").groupBy("word", "check").agg(F.sum("n").alias("n"))


class Lookup:
    """Rank of a word hash among sorted-by-frequency words, -1 if absent: a vectorised open-address table."""

    def __init__(self, words: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(words)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rank = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(words))
        slot = (words >> self.shift).astype(np.int64)
        while len(left):
            free = self.rank[slot] < 0
            self.rank[slot[free][::-1]] = left[free][::-1]
            done = self.rank[slot] == left
            self.keys[slot[done]] = words[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & self.mask

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        at = np.arange(len(words))
        slot = (words >> self.shift).astype(np.int64)
        while len(at):
            rank = self.rank[slot]
            hit = (self.keys[slot] == words[at]) & (rank >= 0)
            out[at[hit]] = rank[hit]
            go = ~hit & (rank >= 0)
            at, slot = at[go], (slot[go] + 1) & self.mask
        return out


class Space:
    """Rows of ``WAYS`` numbers to work in, by name, used again and again: new ones of megabytes cost a page fault every 4 KB."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, like: np.ndarray) -> np.ndarray:
        held = self.held.get(name)
        if held is None or len(held) < rows or held.shape[1:] != like.shape[1:] or held.dtype != like.dtype:
            held = self.held[name] = np.empty((rows + rows // 8, *like.shape[1:]), like.dtype)
        return held[:rows]

    def take(self, name: str, table: np.ndarray, index: np.ndarray) -> np.ndarray:
        """``table[index]``; every index lies in the table (``clip`` only spares numpy a copy)."""
        return table.take(index, axis=0, out=self(name, len(index), table), mode="clip")


def factored(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes within classes of words by equal shares of ``mass`` (descending): each word's nodes and digits (-1 behind its last), each node's log shares."""
    n = len(mass)
    node, alive = np.zeros(n, np.int64), np.arange(n)
    nodes, digits, shares, count = [], [], [], 1
    while len(alive):
        # words of a node are neighbours: their place in its mass gives the digit
        at = node[alive]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sizes = np.diff(first, append=len(alive))
        weight = mass[alive]
        total = np.repeat(np.add.reduceat(weight, first), sizes)
        before = np.cumsum(weight) - weight
        before -= np.repeat(before[first], sizes)
        digit = np.minimum((WAYS * (before + weight / 2) / total).astype(np.int64), WAYS - 1)
        level_nodes, level_digits = np.full(n, -1, np.int32), np.zeros(n, np.int8)
        level_nodes[alive], level_digits[alive] = at, digit
        nodes.append(level_nodes), digits.append(level_digits)
        table = np.zeros((len(first), WAYS))
        np.add.at(table, (np.repeat(np.arange(len(first)), sizes), digit), weight)
        shares.append(table)
        child = at * WAYS + digit
        fresh = np.concatenate([[True], child[1:] != child[:-1]])
        size = np.diff(np.flatnonzero(fresh), append=len(alive))
        lone = np.repeat(size == 1, size)
        group = np.cumsum(fresh & ~lone) - 1  # nodes of the next level, in order
        alive = alive[~lone]
        node[alive] = count + group[~lone]
        count += int((size > 1).sum())
    with np.errstate(divide="ignore"):
        logs = np.log(np.concatenate(shares)) if shares else np.zeros((1, WAYS))
    return np.array(nodes, np.int32).reshape(-1, n).T, np.array(digits, np.int8).reshape(-1, n).T, np.maximum(logs, -1e9).astype(np.float32)


@dataclass
class Model:
    """``words``: frequent hashes, most frequent first; ``counts``: theirs; the first ``own`` have classes of their own. ``rare``: the mass (counts, one each, and one for the unknown) of all others by hash digits."""

    words: np.ndarray
    counts: np.ndarray
    own: int
    total: int
    distinct: int
    rare: np.ndarray
    bits: int
    tables: list[np.ndarray] = made(default_factory=list)

    @classmethod
    def start(cls, words: np.ndarray, counts: np.ndarray, own: int, total: int, distinct: int, rare: np.ndarray, bits: int) -> "Model":
        return cls(words, counts, own, total, distinct, rare, bits, [np.zeros((1 << bits, WAYS), np.float32) for _ in range(FEATURES)])

    def ready(self) -> "Model":
        self.lookup = Lookup(self.words)
        self.levels = int(round(np.log(len(self.rare)) / np.log(WAYS)))
        # rare words are the last of the frequent ones' classes, as one word
        self.nodes, self.digits, self.bias = factored(np.append(self.counts[: self.own] + 1.0, self.rare.sum()))
        self.depth = (self.nodes >= 0).sum(axis=1)
        self.packed = (self.nodes.astype(np.int64) * WAYS + self.digits).ravel()
        base, mass = [len(self.bias)], self.rare
        tables = []
        for _ in range(self.levels):
            tables.append(mass.reshape(-1, WAYS))
            mass = tables[-1].sum(axis=1)
        self.first = []
        for table in tables[::-1]:  # from the coarsest digits on
            self.first.append(base[-1])
            base.append(base[-1] + len(table))
            self.bias = np.concatenate([self.bias, np.log(table).astype(np.float32)])
        self.bias -= self.bias.max(axis=1, keepdims=True)  # so that exponentials need no other care, as a rule
        self.space = Space()
        return self

    def choices(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ranks (-1: rare), and of each choice of a class: its token, node, digit and hashed features (one column a feature)."""
        rank = self.lookup(hashes)
        word = np.where((rank >= 0) & (rank < self.own), rank, self.own)
        behind = np.flatnonzero(word == self.own)  # these go on by their hash digits
        depth = self.depth.take(word)
        depth[behind] += self.levels
        after = np.cumsum(depth)
        n = int(after[-1]) if len(after) else 0
        token = np.repeat(np.arange(len(hashes)), depth)
        packed = self.packed.take(np.repeat(word * self.nodes.shape[1] - after + depth, depth) + np.arange(n), mode="clip")
        node, digit = packed // WAYS, packed % WAYS
        for l in range(self.levels):
            deep = after[behind] - self.levels + l
            head = (hashes[behind] >> np.uint64(64 - 4 * (l + 1))).astype(np.int64)
            node[deep], digit[deep] = self.first[l] + head // WAYS, head % WAYS
        # contexts: a rare word counts as one of 256 groups
        seen = np.where((rank >= 0) & (rank < CONTEXT), rank, (CONTEXT + (hashes >> np.uint64(56)).astype(np.int64))).astype(np.uint64) + np.uint64(1)
        back = []
        for d in (1, 2):
            before = np.zeros(len(seen), np.uint64)  # 0: before the text
            before[d:] = np.where(rows[d:] == rows[:-d], seen[:-d], 0) if len(seen) > d else before[d:]
            back.append(before)
        place = np.arange(len(seen))
        last = np.maximum.accumulate(np.where((rank >= 0) & (rank < ANCHORS), place, -1))
        last = np.concatenate([[-1], last[:-1]])
        anchor = np.where((last >= 0) & (place - last <= LOOK) & (rows[last] == rows), seen[last], 0).astype(np.uint64)
        pair = back[0] * np.uint64(1 << 20) + back[1]
        here = mix(node.view(np.uint64) + np.uint64(0x51))
        shift = np.uint64(64 - self.bits)
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cells = [(mix(np.repeat(v * np.uint64(8) + np.uint64(f), depth) ^ here) >> shift).astype(kind) for f, v in enumerate((back[0], back[1], anchor, pair))]
        return rank, token, node, digit, np.stack(cells).T  # each feature's column in one piece

    def _logits(self, node: np.ndarray, cells: np.ndarray, out: np.ndarray) -> np.ndarray:
        self.bias.take(node, axis=0, out=out, mode="clip")
        for f in range(FEATURES):
            out += self.space.take("row", self.tables[f], cells[:, f])
        return out

    def odds(self, node: np.ndarray, digit: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log probability of each choice, the odds of all classes there (in the model's own space, until the next call) and their sums."""
        n = len(node)
        odds, sums, value = self.space("odds", n, self.bias), np.empty(n, np.float32), np.empty(n, np.float32)
        for a in range(0, n, NEAR):
            part = slice(a, min(a + NEAR, n))
            z = self._logits(node[part], cells[part], odds[part])
            at = np.arange(0, z.size, WAYS) + digit[part]
            chosen = z.ravel().take(at)
            with np.errstate(over="ignore"):
                s = np.einsum("ij->i", np.exp(z, out=z))
            if not (s.min() > 1e-30 and s.max() < 1e30):  # weights far out: from each row's greatest
                z = self._logits(node[part], cells[part], z)
                z -= z.max(axis=1, keepdims=True)
                chosen = z.ravel().take(at)
                s = np.einsum("ij->i", np.exp(z, out=z))
            sums[part], value[part] = s, chosen - np.log(s)
        return value, odds, sums

    def forward(self, node: np.ndarray, digit: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each choice, and the probabilities of all classes there (until the next call)."""
        value, p, s = self.odds(node, digit, cells)
        p /= s[:, None]
        return value, p

    def log_probabilities(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and natural log probabilities of tokens (a rare one's: of its digits), piece by piece, contexts whole."""
        ranks, values = np.empty(len(hashes), np.int64), np.empty(len(hashes))
        for a in range(0, len(hashes), PIECE):
            lo, hi = max(0, a - LOOK), min(a + PIECE, len(hashes))
            rank, token, node, digit, cells = self.choices(hashes[lo:hi], rows[lo:hi])
            value = np.concatenate([self.odds(node[b : b + MINIBATCH], digit[b : b + MINIBATCH], cells[b : b + MINIBATCH])[0] for b in range(0, len(node), MINIBATCH)])
            ranks[a:hi], values[a:hi] = rank[a - lo :], np.bincount(token, value, hi - lo)[a - lo :]
        return ranks, values

    def learn(self, node: np.ndarray, digit: np.ndarray, cells: np.ndarray, squares: list[np.ndarray], moved: list[np.ndarray]) -> None:
        """One AdaGrad step; ``moved`` counts the choices of each row."""
        near = _by_row(cells[:, 0])  # choices of one row of the first feature, so of one node, lie together: fewer places in memory
        node, digit, cells = node.take(near), digit.take(near), np.stack([c.take(near) for c in cells.T]).T
        _, p = self.forward(node, digit, cells)
        p.ravel()[np.arange(0, p.size, WAYS) + digit] -= 1
        for f in range(FEATURES):
            _update(self.tables[f], squares[f], moved[f], cells[:, f], p, self.space)


def _by_row(index: np.ndarray) -> np.ndarray:
    """The stable order of table rows. Numpy sorts 16 bits by radix, more by merges: so in two passes."""
    if (index[1:] >= index[:-1]).all():
        return np.arange(len(index))
    low = np.argsort(index.astype(np.uint16), kind="stable")
    return low if index.dtype == np.uint16 else low.take(np.argsort((index >> 16).astype(np.uint16).take(low), kind="stable"))


def _update(table: np.ndarray, square: np.ndarray, moved: np.ndarray, index: np.ndarray, grad: np.ndarray, space: Space) -> None:
    """Adds each choice's gradient to its feature row: sort by row (radix), sum runs, scale by row."""
    order = _by_row(index)
    rows = index.take(order)
    fresh = np.concatenate([[True], rows[1:] != rows[:-1]])
    sums, first = _run_sums(grad, order, fresh, space=space)
    at = rows.take(first).astype(np.int64)
    squared = square.take(at) + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
    square[at] = squared
    sums *= (RATE / np.sqrt(squared))[:, None]
    now = space.take("now", table, at)
    now -= sums
    whole = f"V{table.itemsize * table.shape[1]}"  # a row as one item
    table.view(whole)[:, 0][at] = now.view(whole)[:, 0]
    np.add.at(moved, rows.astype(np.int64), 1)


def _run_sums(values: np.ndarray, source: np.ndarray, fresh: np.ndarray, piece: int = 16, space: Space | None = None, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows ``source`` of ``values`` by run (``fresh``: a run's first), and where each run starts.

    Runs are cut into pieces; the pieces, longest first, add up their j-th rows together for each j,
    whole rows at a time. Pieces of one run are summed likewise. Runs come in no set order.
    """
    space = space or Space()
    starts = np.flatnonzero(fresh)
    cuts, lengths = starts, np.diff(starts, append=len(source))
    long = np.flatnonzero(lengths > piece)
    if len(long):
        more = (lengths[long] - 1) // piece
        place = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        cut = fresh.copy()
        cut[np.repeat(starts[long], more) + piece * place] = True
        cuts = np.flatnonzero(cut)
        lengths = np.diff(cuts, append=len(source))
    order = np.argsort((piece - lengths).astype(np.uint8), kind="stable")
    longest_first = cuts.take(order)
    sums = space.take(f"sums {level}", values, source.take(longest_first))
    longer = np.cumsum(np.bincount(lengths, minlength=piece + 1)[::-1])[::-1]  # pieces of j rows or more
    for j in range(1, piece):
        if not (n := longer[j + 1]):
            break
        sums[:n] += space.take("more", values, source.take(longest_first[:n] + j))
    if len(cuts) == len(starts):
        return sums, longest_first
    where = np.empty(len(cuts), np.int64)
    where[order] = np.arange(len(cuts))
    sums, first = _run_sums(sums, where, fresh.take(cuts), piece, space, level + 1)
    return sums, cuts.take(first)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers by zstd, without loss: the first bytes of all of them, then the second ones, which are more alike."""
    planes = np.ascontiguousarray(numbers.reshape(-1, 1).view(np.uint8).T)
    return pa.compress(planes.ravel(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def train(docs: DataFrame, model: Model, text_col: str) -> Model:
    """One distributed round over all texts: local steps, then each row's average over the tasks that moved it, by how often."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    size = 1 << model.bits
    step = FEATURES * size // BLOCKS

    def run(batches):
        base = sent.value
        own = Model.start(base.words, base.counts, base.own, base.total, base.distinct, base.rare, base.bits).ready()
        own.tables = [t.copy() for t in base.tables]
        squares, moved = [np.full(size, 1.0, np.float32) for _ in range(FEATURES)], [np.zeros(size, np.int64) for _ in range(FEATURES)]
        seen = 0
        for batch in batches:
            for *_, hashes, rows, _ in tokens(batch.column(0)):
                for a in range(0, len(hashes), PIECE):
                    _, token, node, digit, cells = own.choices(hashes[a : a + PIECE], rows[a : a + PIECE])
                    at, here = 0, len(hashes[a : a + PIECE])
                    while at < here:
                        n = min(MINIBATCH, FIRST_BATCH + seen // 8)  # short steps first, or few texts would make few
                        b, c = np.searchsorted(token, [at, at + n])
                        own.learn(node[b:c], digit[b:c], cells[b:c], squares, moved)
                        at, seen = at + n, seen + n
        if any(m.any() for m in moved):
            context = TaskContext.get()
            task = context.partitionId() if context else 0
            for block in range(BLOCKS):
                f, a = divmod(block * step, size)
                weight, change = moved[f][a : a + step].astype(np.float32), (own.tables[f][a : a + step] - base.tables[f][a : a + step]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task], pa.int64()), pa.array([packed(weight)], pa.binary()), pa.array([packed(change)], pa.binary())], names=["block", "task", "weight", "moved"])

    def average(table: pa.Table) -> pa.Table:
        weight, total = np.zeros(step), np.zeros((step, WAYS))
        for w, m in zip(table.column("weight"), table.column("moved")):
            w = unpacked(w.as_py(), np.float32, step).astype(np.float64)
            total += w[:, None] * unpacked(m.as_py(), np.float16, step * WAYS).reshape(step, WAYS)
            weight += w
        total /= np.maximum(weight, 1)[:, None]
        return pa.table({"block": table.column("block")[:1], "task": table.column("task")[:1], "weight": pa.array([packed(weight.astype(np.float32))], pa.binary()), "moved": pa.array([packed(total.astype(np.float16))], pa.binary())})

    schema = "block int, task long, weight binary, moved binary"
    # small partitions are read together, without an exchange
    source = docs.select(docs[text_col].cast("string")).coalesce(max(1, model.total // (TASK_TOKENS * size)))
    rows, left = source.mapInArrow(run, schema), source.rdd.getNumPartitions()
    while True:  # a tree of sums: no task meets more than ``FAN`` updates of a block
        left = -(-left // FAN)
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN).cast("long")).groupBy("block", "task").applyInArrow(average, schema)
        if left <= 1:
            break
    rows = sorted(rows.collect(), key=lambda r: r["block"])
    sent.unpersist()
    if not rows:
        return model
    moved = np.concatenate([unpacked(r["moved"], np.float16, step * WAYS) for r in rows]).astype(np.float32).reshape(FEATURES, size, WAYS)
    return Model(model.words, model.counts, model.own, model.total, model.distinct, model.rare, model.bits, [t + m for t, m in zip(model.tables, moved)])


def fit(docs: DataFrame, text_col: str = "text", known: int = KNOWN) -> tuple[Model, DataFrame]:
    """A model of all texts, and the counts of all words. Without rows: every token is unknown."""
    counts = stored(count_words(docs, text_col), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the end token first, then by frequency
    end = int(END.view(np.int64))
    top = counts.orderBy((F.col("word") != end), F.desc("n"), "word").limit(known).toArrow()
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(-n, kind="stable")
    words, n = words[order], n[order]
    own = len(words)
    # the mass of rare words by hash digits: all words' less those of their own classes
    levels = int(np.clip(np.ceil(np.log(max(1, int(total["v"]) - own) / 256) / np.log(WAYS)), 0, DIGITS))
    rare = np.ones(WAYS**levels)
    lead = np.uint64(64 - 4 * levels)
    if levels:
        head = F.shiftrightunsigned("word", int(lead))
        for r in counts.groupBy(head.alias("head")).agg(F.sum(F.col("n") + 1).alias("m")).collect():  # 16 ** DIGITS rows at most
            rare[r["head"]] += r["m"]
        np.subtract.at(rare, (words[:own] >> lead).astype(np.int64), n[:own] + 1)
    else:
        rare[0] += int(total["n"]) + int(total["v"]) - int((n[:own] + 1).sum())
    bits = int(np.clip(np.ceil(np.log2(max(1, int(total["n"]) / TOKENS))), *BITS))
    return train(docs, Model.start(words, n, own, int(total["n"]), int(total["v"]), rare, bits), text_col), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Null and empty texts have the end token alone. Repeated rows are scored alike, each in a row of
    its own; very long texts are scored whole, piece by piece; an empty table gives no rows. Scores
    are base-10 log probabilities; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    def start():
        own = sent.value.ready()
        log_counts = np.log10(own.counts + 1.0)
        log_rare = np.log10(own.rare)

        def step(column):
            n_rows = len(column)
            n_tokens, n_known = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
            base, model_score = np.zeros(n_rows), np.zeros(n_rows)
            rare: list[np.ndarray] = [np.empty(0, np.int64)] * n_rows
            check: list[np.ndarray] = [np.empty(0, np.int64)] * n_rows
            times: list[np.ndarray] = [np.empty(0, np.int64)] * n_rows
            for first, n, hashes, rows, second in tokens(column):
                for a in range(0, n, 64):  # whole texts, some at a time
                    lo, hi = np.searchsorted(rows, [a, min(n, a + 64)])
                    h, r = hashes[lo:hi], rows[lo:hi]
                    rank, value = own.log_probabilities(h, r)
                    value /= np.log(10)
                    frequent = rank >= 0
                    logs = np.where(frequent, log_counts[np.maximum(rank, 0)] if len(log_counts) else 0.0, 0.0)
                    few = np.flatnonzero(~frequent | (rank >= own.own))
                    value[few] += logs[few] - log_rare[(h[few] >> np.uint64(64 - 4 * own.levels)).astype(np.int64) if own.levels else 0]
                    odd = np.flatnonzero(~frequent)
                    m = min(n, a + 64) - a
                    out = slice(first + a, first + a + m)
                    n_tokens[out] = np.bincount(r - a, minlength=m)
                    n_known[out] = np.bincount(r - a, frequent, m)
                    base[out] = np.bincount(r - a, logs, m)
                    model_score[out] = np.bincount(r - a, value, m)
                    cuts = np.searchsorted(r[odd], np.arange(a, a + m + 1))
                    lanes = second(lo + odd)
                    for i in np.flatnonzero(np.diff(cuts)):
                        part = slice(cuts[i], cuts[i + 1])
                        w, at, c = np.unique(h[odd[part]], return_index=True, return_counts=True)
                        rare[first + a + i], check[first + a + i], times[first + a + i] = w.view(np.int64), lanes[part][at].view(np.int64), c
            long_list = pa.list_(pa.int64())
            return [pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(model_score), pa.array(rare, long_list), pa.array(check, long_list), pa.array(times, long_list)]

        return step

    fields = [field("n_tokens", "long"), field("__known", "long"), field("__base", "double"), field("__score", "double"), field("__rare", "array<bigint>"), field("__check", "array<bigint>"), field("__times", "array<bigint>")]
    rows = docs.select(docs[id_col].alias("doc_id"), held_out.alias("held_out"), docs[text_col].alias("__body"))
    scored = stored(append_columns(rows, "__body", start, fields, keep=["doc_id", "held_out"]).withColumn("__row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("__row", F.explode(F.arrays_zip("__rare", "__check", "__times")).alias("w")).select("__row", F.col("w.__rare").alias("word"), F.col("w.__check").alias("check"), F.col("w.__times").alias("times"))
    found = rare.join(counts, ["word", "check"]).groupBy("__row").agg(F.sum("times").alias("__k"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("__l"))
    every = scored.drop("__rare", "__check", "__times").join(found, "__row", "left")
    extra = F.coalesce("__l", F.lit(0.0))
    return every.select(
        "doc_id", "held_out", "n_tokens", (F.col("__known") + F.coalesce("__k", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("__base") + extra - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1)))).alias("base_score"), (F.col("__score") + extra).alias("score"),
    )

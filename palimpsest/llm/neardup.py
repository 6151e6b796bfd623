"""MinHash near-duplicates with sequential Bayesian verification (operator 6).

Exact copies of a shingle set collapse to a class first, so no later step sees a copy twice. The
classes' signatures are banded. Candidates come in two rounds, and neither emits the pairs of a
bucket: first each member against the bucket's smallest id; then, in buckets that still hold
different components, block against block of bounded size, where only members of different
components are compared, each pair in the first band it shares, and only new links leave the task.
Candidates are compared signature batch by signature batch, and dropped once the posterior chance
that they reach the threshold falls under ``MISS``; survivors are confirmed on their full shingle
sets. Components of the links are found by minimum label propagation with pointer jumping. Shingles
are hashed to 128 bits for the confirmation; the first half alone makes the signatures. Every
intermediate table is written to the shared folder and deleted at the end; nothing of the corpus
comes to the driver but counts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.llm.batches import LOWER_TABLE, SPACE_TABLE, append_columns, flat, fresh, groups, mix, shingle_hashes, span_hashes, spans
from palimpsest.runtime import Scratch, prepare, stored

#: 24 bands of 6: two sets of similarity 0.85 share no band with chance 1.2e-5, of 0.8 with 7e-4 at 24 and 2e-5 at 36.
ROWS = 6
#: Chance of a miss under which a candidate is dropped, at each batch.
MISS = 1e-6
BATCH = 24
#: Members of a block; two blocks are compared in one task.
BLOCK = 1024


def bands_for(similarity: int) -> int:
    """Bands so that a pair just at the threshold is missed with chance 2e-5 at most."""
    return int(np.ceil(np.log(2e-5) / np.log1p(-((similarity / 100) ** ROWS))))


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    b = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return a, b


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingles of each text as 128-bit hashes, two rows of 64 bits, sorted: ``k`` words, or all where there are fewer; none without words."""
    data, offsets = flat(column)
    out: list[np.ndarray] = []
    for a, b in groups(offsets, 1 << 20):
        part, offs = LOWER_TABLE[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, docs = spans(part, offs, SPACE_TABLE)
        words = [span_hashes(part, starts, ends, lane) for lane in (0, 1)]
        (one, owner), (two, _) = (shingle_hashes(w, docs, k) for w in words)
        cuts = np.searchsorted(owner, np.arange(b - a + 1))
        wcuts = np.searchsorted(docs, np.arange(b - a + 1))
        for i in range(b - a):
            own = one[cuts[i] : cuts[i + 1]], two[cuts[i] : cuts[i + 1]]
            if not len(own[0]) and wcuts[i + 1] > wcuts[i]:
                own = tuple(_whole(w[wcuts[i] : wcuts[i + 1]]) for w in words)
            out.append(_distinct(*own))
    return out


def _whole(words: np.ndarray) -> np.ndarray:
    h = np.full(1, np.uint64(len(words) + 1000))
    for w in words:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h


def _distinct(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The distinct pairs, sorted."""
    order = np.argsort(one)
    one, two = one[order], two[order]
    same = one[1:] == one[:-1]
    if same.any():
        if (two[1:] != two[:-1])[same].any():  # the first lane collides
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
        keep = np.ones(len(one), bool)
        keep[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        one, two = one[keep], two[keep]
    return np.stack([one, two])


def _sketches(sets: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit signature values and 64-bit band keys of non-empty sets (zeros for empty ones)."""
    p = bands * ROWS
    a, b = _permutations(p)
    low = np.zeros((len(sets), p), np.uint64)
    i = 0
    while i < len(sets):  # blocks that stay in the processor's cache
        j, size = i, 0
        while j < len(sets) and (j == i or size + sets[j].shape[1] < 16_384):
            size += sets[j].shape[1]
            j += 1
        full = [s for s in range(i, j) if sets[s].shape[1]]
        if full:
            x = np.concatenate([sets[s][0] for s in full])
            starts = np.cumsum([0, *(sets[s].shape[1] for s in full[:-1])])
            for q in range(p):
                low[full, q] = np.minimum.reduceat(x * a[q] + b[q], starts)
        i = j
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + low[:, r::ROWS][:, :bands] + np.uint64(r))
    return (low >> np.uint64(48)).astype("<u2"), keys.astype(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, body, text``: a row is known by its id and a digest of its text, as an id may stand beside several texts."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(F.unhex(F.md5(docs[text_col].cast("binary"))), F.lit(b"")).alias("body"), docs[text_col].alias("text"))


def sketch(rows: DataFrame, k: int, bands: int) -> DataFrame:
    """``doc_id, body, n_shingles, digest, sig, bands`` per row of ``keyed``; the digest is null where there are no shingles."""

    def start():
        def step(column):
            sets = shingle_sets(column, k)
            sig, keys = _sketches(sets, bands)
            return [
                pa.array([s.shape[1] for s in sets], pa.int64()), pa.array([hashlib.md5(s.tobytes()).digest() if s.size else None for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())),
            ]
        return step

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return append_columns(rows, "text", start, fields, keep=["doc_id", "body"])


@lru_cache
def least_matches(hashes: int, similarity: int) -> tuple[tuple[int, int], ...]:
    """(hashes compared, matches below which the posterior chance of the threshold is under ``MISS``), batch by batch; uniform prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        need = 0
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(logs - logs.max())
            if weight[grid >= similarity / 100].sum() / weight.sum() >= MISS:
                need = m
                break
        out.append((n, need))
    return tuple(out)


def _survive(a: np.ndarray, b: np.ndarray, similarity: int) -> np.ndarray:
    """Indices of the row pairs that no batch rules out."""
    alive = np.arange(len(a))
    matches, last = np.zeros(len(a), np.int64), 0
    for n, need in least_matches(a.shape[1], similarity):
        matches = matches + (a[alive, last:n] == b[alive, last:n]).sum(axis=1)
        keep = matches >= need
        alive, matches, last = alive[keep], matches[keep], n
    return alive


def _bayes(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """The candidate pairs ``a, b`` that survive the signature batches."""
    one = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    two = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.stack([np.frombuffer(x.as_py(), "<u2") for x in batch.column(c)]) for c in (2, 3))
                keep = pa.array(_survive(sa, sb, similarity))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(x: list[np.ndarray], y: list[np.ndarray], similarity: int) -> bool:
    """Whether two sets reach the similarity (percent). A set is its sorted first lane, with or without the second beside it.

    First lanes alone can only overrate a pair, by a collision of 64 bits.
    """
    n, m = len(x[0]), len(y[0])
    if 100 * min(n, m) < similarity * max(n, m):
        return False
    if len(x) > 1 and ((x[0][1:] == x[0][:-1]).any() or (y[0][1:] == y[0][:-1]).any()):  # a first lane collides within its set
        both = len(set(zip(*(lane.tolist() for lane in x))) & set(zip(*(lane.tolist() for lane in y))))
    else:
        at = np.minimum(np.searchsorted(x[0], y[0]), n - 1)
        both = int(np.logical_and.reduce([a[at] == b for a, b in zip(x, y)]).sum())
    return 100 * both >= similarity * (n + m - both)


def _lanes(*raw: bytes) -> list[np.ndarray]:
    return [np.frombuffer(r, np.uint64) for r in raw]


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs linked by their full sets of 128-bit shingles."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"), F.col("second").alias("ta"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"), F.col("second").alias("tb"))

    def run(batches):
        for batch in batches:
            keep = [i for i, (x, xx, y, yy) in enumerate(zip(*batch.columns[2:])) if _linked(_lanes(x.as_py(), xx.as_py()), _lanes(y.as_py(), yy.as_py()), similarity)]
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "ta", "sb", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, label``: the smallest node reachable from each node of the edges ``a, b``."""
    stored = (scratch or Scratch(edges.sparkSession)).stored
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.a == labels.node).groupBy("b").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels.node == heard.b).select("node", F.least("label", "heard").alias("new"), F.col("label").alias("old"))
        nearer = stored(nearer, "nearer")
        ahead = nearer.select(F.col("node").alias("at"), F.col("new").alias("jump"))
        jumped = stored(nearer.join(ahead, nearer.new == ahead.at).select("node", F.col("jump").alias("label"), (F.col("jump") != F.col("old")).alias("changed")), "labels")
        if not jumped.where("changed").limit(1).count():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def _merge(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after more links, which are contracted to the components so far."""
    if labels is None:
        return components(links, scratch)
    name = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    lifted = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    joined = components(lifted, scratch)
    step = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    old = labels.join(step, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return scratch.stored(old.union(fresh), "labels")


def _rest(entries: DataFrame, labels: DataFrame, full_sets: DataFrame, similarity: int, lanes: tuple[str, ...]) -> DataFrame:
    """Links ``a, b`` between components that share a bucket, its first member aside: block against block, by the given lanes."""
    named = labels.select(F.col("node").alias("rep"), "label")
    members = entries.join(named, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = members.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").select("band", "key", "center", "n")
    open_ = members.join(mixed, ["band", "key"]).where("rep <> center")
    per = open_.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("band", "key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("c_main"), F.sum("c").alias("c_all")).where("c_main < c_all")
    open_ = open_.join(top, ["band", "key"])
    # the largest component's blocks meet the others' blocks, not one another
    n_main = F.ceil(F.col("c_main") / BLOCK).cast("int")
    n_rest = F.ceil((F.col("c_all") - F.col("c_main")) / BLOCK).cast("int")
    main = F.col("label") == F.col("main")
    spread = F.xxhash64(F.col("rep"), F.lit(5))
    block = F.when(main, F.pmod(spread, n_main)).otherwise(F.pmod(spread, n_rest)).cast("int")
    rest = F.sequence(F.lit(0), n_rest - 1)
    placed = open_.withColumn("block", block).withColumn(
        "meets",
        F.when(main, F.transform(rest, lambda r: F.struct(r.alias("r"), (-1 - F.col("block")).alias("o"))))
        .otherwise(F.concat(
            F.transform(F.sequence(F.lit(0), n_main - 1), lambda m: F.struct(F.col("block").alias("r"), (-1 - m).alias("o"))),
            F.transform(rest, lambda r: F.struct(F.greatest(r, F.col("block")).alias("r"), F.least(r, F.col("block")).alias("o"))),
        )),
    )
    met = placed.select("band", "key", "rep", "label", F.explode("meets").alias("m")).select("band", "key", F.col("m.r").alias("r"), F.col("m.o").alias("o"), "rep", "label")
    full = met.join(full_sets.select("rep", "sig", "keys", *lanes), "rep")

    def compare(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        rep, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
        sig = np.stack([np.frombuffer(x.as_py(), "<u2") for x in table.column("sig")])
        keys = np.stack([x.values.to_numpy() for x in table.column("keys")])
        sets = [_lanes(*(x.as_py() for x in row)) for row in zip(*(table.column(lane) for lane in lanes))]
        names, owner = np.unique(label, return_inverse=True)  # components, merged as links are found
        # the smaller components ask, so that a large one is compared with few
        order = np.argsort(np.bincount(owner, minlength=len(names))[owner], kind="stable")
        out_a, out_b = [], []
        for at, i in enumerate(order[:-1]):
            others = order[at + 1 :]
            others = others[owner[others] != owner[i]]
            if not len(others):
                continue
            shared = keys[others] == keys[i]
            others = others[shared.argmax(axis=1) == band]
            if not len(others):
                continue
            others = others[_survive(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others], similarity)]
            for j in others[np.argsort(-(sig[others] == sig[i]).sum(axis=1), kind="stable")]:
                if owner[j] != owner[i] and _linked(sets[i], sets[j], similarity):
                    owner[owner == owner[j]] = owner[i]
                    out_a.append(min(rep[i], rep[j]))
                    out_b.append(max(rep[i], rep[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return full.groupBy("band", "key", "r", "o").applyInArrow(compare, "a long, b long").distinct()


def _resolved(sketches: DataFrame, rows: DataFrame, shingle: int, similarity: int, scratch: Scratch) -> DataFrame:
    """``digest, label, component_id`` of the classes (rows of equal shingle sets): their component and its least id.

    Classes are numbered, and ids are compared only where a component gets its least one, so an id
    may stand in several classes.
    """
    stored = scratch.stored
    grouped = sketches.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "body")).alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))  # equal sets have equal signatures
    classes = stored(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = classes.select("rep", "sig", "bands")
    entries = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(entries.join(buckets.select("band", "key", "center"), ["band", "key"]), "entries")
    asked = classes.join(shared.select("rep").distinct(), "rep").select("rep", F.col("least.doc_id").alias("doc_id"), F.col("least.body").alias("body"), "sig", F.col("bands").alias("keys"))

    def start():
        def step(column):
            sets = shingle_sets(column, shingle)
            return [pa.array([s[0].tobytes() for s in sets], pa.binary()), pa.array([s[1].tobytes() for s in sets], pa.binary())]
        return step

    fields = [T.StructField("shingles", T.BinaryType()), T.StructField("second", T.BinaryType())]
    texts = rows.join(asked, ["doc_id", "body"]).dropDuplicates(["doc_id", "body"])  # repeated rows; the join's partitions serve
    sets = stored(append_columns(texts, "text", start, fields, keep=["rep", "sig", "keys"]), "sets")

    star = shared.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    labels = _merge(None, stored(_confirm(_bayes(star, reps, similarity), sets, similarity), "links"), scratch)
    members = shared.select("rep", "band", "key")
    found = stored(_rest(members, labels, sets, similarity, ("shingles",)), "rest")
    if n := found.count():
        sure = stored(_confirm(found, sets, similarity), "sure")
        # a link by a collision of 64 bits may have hidden others: then once more with both lanes
        found = sure if sure.count() == n else stored(_rest(members, labels, sets, similarity, ("shingles", "second")), "rest")
        labels = _merge(labels, found, scratch)
    labelled = classes.select("rep", "digest", "least.doc_id").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    return stored(labelled.join(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("digest", "label", "component_id"), "named")


def near_duplicates(docs: DataFrame, shingle: int = 3, similarity: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row; ids are integers (others must be mapped to such first).

    Words are lower-cased in ASCII. A text without words (or null) has no shingles and is linked
    with nothing. Rows of a null id are components of their own: their ``component_id`` is null and
    they are kept. A component's id is the smallest one in it; ``kept`` tells the rows of that id. Rows
    of equal id and text are copies; rows of equal id and other texts are documents of their own
    that share the name, so each may be kept. Very long texts are sketched whole, one at a time. An
    empty table gives no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    scratch, rows = Scratch(docs.sparkSession), keyed(docs, id_col, text_col)
    sketches = scratch.stored(sketch(rows, shingle, bands_for(similarity)), "sketch")
    known = sketches.where("doc_id is not null")
    of_class = _resolved(known, rows, shingle, similarity, scratch)
    kept = F.col("doc_id") == F.col("component_id")
    named = known.where("n_shingles > 0").join(of_class, "digest").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
    lone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    result = stored(named.union(lone), "near")
    scratch.drop()
    return result


def keep_one(docs: DataFrame, shingle: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: one of each component (its smallest id, then digest of the text), and all without an id.

    Only rows that are equal in id and text become one; an id beside several unlike texts keeps them all. Texts without
    words (null, empty) are linked with nothing and stay. An empty table stays empty. Other columns stay, whatever their
    names. Very long texts are sketched whole, one at a time.
    """
    prepare(docs.sparkSession)
    scratch, rows = Scratch(docs.sparkSession), keyed(docs, id_col, text_col)
    sketches = scratch.stored(sketch(rows, shingle, bands_for(similarity)), "sketch")
    known = sketches.where("doc_id is not null")
    of_class = _resolved(known, rows, shingle, similarity, scratch)
    chosen = known.where("n_shingles > 0").join(of_class, "digest").groupBy("label").agg(F.min(F.struct("doc_id", "body")).alias("one")).select("one.*")
    keys = stored(chosen.union(known.where("n_shingles = 0").select("doc_id", "body")).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body")), "kept")
    scratch.drop()
    digest = fresh(docs, "__own")
    own = docs.withColumn(digest, F.coalesce(F.unhex(F.md5(docs[text_col].cast("binary"))), F.lit(b"")))
    left = own.join(keys, (own[id_col].cast("long") == keys["__id"]) & (own[digest] == keys["__body"]), "left_semi").dropDuplicates([id_col, digest])
    return left.union(own.where(F.col(id_col).isNull())).drop(digest)

"""Search, sharding and resampling on odd tables, against plain computations."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lexical, resample, slots, words
from palimpsest.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "...", "a", "A b-b_b é☃ É", "x" * 70_000, "the " * 30_000, "tail\x00of\x7fit", "İ 0 12a", "😀😀 a😀"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORDS.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["the", "of", "É"]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(150)]
    return ODD + made + made[:30] + [made[0]] * 25


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Repeated texts, a repeated row, a null id, and columns that clash with the operators' own."""
    rows = [(i * 7 % 1000, t, "s", 1, 2.0, 3) for i, t in enumerate(texts)] + [(0, texts[0], "s", 1, 2.0, 3), (None, "the of w1 w2 " * 9, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, rank int, score double, slot int").repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the of w1"), (2, "w1 w1 w1 w2 w3 the"), (3, None), (4, ""), (5, "nowhere"), (2, "w5 É"), (None, "x😀 a😀"), (9, "The OF " * 40)]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, rank int")


def ranked(rows, items, k=10):
    """Every document's score for every item, plainly."""
    held = [(d, Counter(words_of(t))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words_of(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda r: r[:3])[:k])]
    return sorted(out, key=str)


def test_word_pieces_and_checksums(texts):
    whole = pa.array(texts, pa.string())
    for size in (7, 64, 1 << 20):
        got = defaultdict(list)
        for data, starts, ends, rows in words.word_pieces(whole, size):
            sums = words.crc32_words(data, starts, ends)
            for a, b, r, c in zip(starts, ends, rows, sums):
                word = data[a:b].tobytes()
                assert zlib.crc32(word) == c
                got[int(r)].append(word.decode())
        assert [got[i] for i in range(len(texts))] == [words_of(t) for t in texts]


@pytest.mark.parametrize("block", [1, 3000, 8 << 20])
def test_search_equals_every_score(spark, docs, items, tmp_path, block, monkeypatch):
    monkeypatch.setattr(lexical, "STEP", 8)  # many steps, so that bounds end the processing
    monkeypatch.setattr(lexical, "ITEMS", 3)
    index = lexical.index(docs, str(tmp_path / "i"), block_bytes=block)
    got = lexical.search(index, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_no_reader_meets_two_blocks_of_the_index_at_once(spark, docs, tmp_path):
    """A row group is read whole, so one that holds a task's blocks grows with the input."""
    lexical.index(docs.coalesce(1), str(tmp_path / "i"), block_bytes=3000)
    files = [pq.read_metadata(f) for f in (tmp_path / "i").glob("*.parquet")]
    sizes = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert len(sizes) > 10 and set(sizes) == {1}


def test_search_stops_early_and_ends_right(monkeypatch):
    """Bounds end a block before its last posting; the scores are whole."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", *map(str, range(40))]) for _ in range(rng.randint(5, 60))) + (" rare" * 5 if i % 50 == 0 else "") for i in range(2000)]
    row = lexical._block(pa.array(range(2000)), pa.array(texts), ["ids", "lengths", "terms", "starts", "rows", "counts", "n_docs", "n_terms"]).to_struct_array()[0]
    terms = ["rare", "the"]
    df = [sum(t in x.split() for x in texts) for t in terms]
    weights = np.array([math.floor(1000 * math.log(4002 / (2 * d + 1))) for d in df])
    block = lexical._Block(row, pa.array(terms), weights, 2000, sum(len(x.split()) for x in texts), 75, 8)
    monkeypatch.setattr(lexical, "STEP", 16)
    added = []
    real = np.add.at
    monkeypatch.setattr(lexical.np, "add", type("A", (), {"at": staticmethod(lambda s, i, v: (added.append(len(i)), real(s, i, v)))}))
    found, score = block.best(np.array([0, 1]), np.array([1, 1]), 10, 0)
    monkeypatch.undo()
    want = [r[2:] for r in ranked(list(enumerate(texts)), [(0, "rare the")])]
    order = sorted(zip((-score).tolist(), found.tolist()))[:10]
    assert sorted((d, -s) for s, d in order) == sorted(want)
    assert 0 < sum(added) < len(block.ordered) // 2


def test_search_of_empty_tables(spark, empty, items, docs, tmp_path):
    index = lexical.index(empty, str(tmp_path / "a"))
    assert lexical.search(index, items).collect() == []
    assert lexical.search(lexical.index(docs, str(tmp_path / "b")), items.where("false")).collect() == []


def test_slots_balance_and_number(spark, docs, texts, tmp_path):
    path = str(tmp_path / "map")
    rows = slots.shard(docs, shards=5, path=path).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r)
        key = f"{'' if r['doc_id'] is None else r['doc_id']}:{r['text_crc32']}"
        assert r["virtual_slot"] == int(hashlib.md5(key.encode()).hexdigest()[:4], 16) % slots.SLOTS and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in held.values())
    # the two long texts outweigh a shard's share of the rest; what is beside them is even
    sizes = sorted(sum(r["size"] for r in own) for own in held.values())
    assert len(held) == 5 and sizes[-3] - sizes[0] < 700
    kept = slots.SlotMap(spark, path)
    assert kept.versions() == [0, 1] and [r[3] for r in kept.rows(0)] == [s % 5 for s in range(slots.SLOTS)]
    moved = sum(a != b for a, b in zip(kept.rows(0), kept.rows(1)))
    assert {r["shard"] for r in kept.load().collect()} == set(range(5)) and moved < slots.SLOTS


def test_map_edits_move_little():
    rng = random.Random(1)
    sums = [{"slot": s, "n": 1, "bytes": rng.randint(500, 1500)} for s in range(4096)]
    first = slots.edited(slots.first_map(sums, shards=24), sums, 24)
    load = lambda m, n: [sum(sums[r[0]]["bytes"] for r in m if r[3] == s) for s in range(n)]
    assert max(load(first, 24)) - min(load(first, 24)) <= 1500
    again = slots.edited(first, sums, 24)
    assert sum(a != b for a, b in zip(first, again)) <= 24 * 2
    grown = slots.edited(again, sums, 25)
    changed = [(a, b) for a, b in zip(again, grown) if a != b]
    moved = sum(sums[a[0]]["bytes"] for a, _ in changed)
    assert sum(b[3] == 24 for _, b in changed) > 0.9 * len(changed) and moved < sum(r["bytes"] for r in sums) / 25 * 1.2
    assert max(load(grown, 25)) - min(load(grown, 25)) <= 1500
    fewer = slots.edited(grown, sums, 23)
    assert {r[3] for r in fewer} == set(range(23))


def test_a_heavy_slot_is_dealt_in_parts(spark, tmp_path):
    """A third of all rows are one row repeated: no shard holds it alone, and places stay gapless."""
    docs = spark.range(9000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 3000, "same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    rows = slots.shard(docs, shards=4, path=str(tmp_path / "m"), cell_rows=100).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in own) for own in held.values()]
    assert len(rows) == 9000 and max(sizes) < 1.1 * min(sizes)
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in held.values())


def test_sharding_an_empty_table(spark, empty):
    assert slots.shard(empty).collect() == []
    with pytest.raises(ValueError):
        slots.slotted(empty, slots=1000)


def drawn(rows, target, percent, seed, runs=(1, 1), least=20):
    grams = lambda t: [" ".join(w[i : i + k]) for w in [words_of(t)] for k in range(runs[0], runs[1] + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in xs for f in grams(x)) for xs in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for d, x in rows:
        own = [gain(bucket(f)) for f in grams(x)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for i, r in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(id(r), i + 1)
    return sorted((str((*r[:4], rank.get(id(r)))) for r in out))


@pytest.mark.parametrize("percent,runs", [(10, (1, 1)), (100, (1, 1)), (37, (1, 3))])
def test_resampling_equals_the_plain_one(spark, docs, items, percent, runs, monkeypatch):
    if runs != (1, 1):
        monkeypatch.setattr(resample, "word_pieces", lambda c: words.word_pieces(c, 1000))
    got = resample.resample(docs, items, percent=percent, runs=runs, part_rows=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # equal rows share their ranks in either order
    plain = lambda rs: sorted(rs)
    assert plain(str(tuple(r)) for r in got.collect()) == drawn(rows, [r["text"] for r in items.collect()], percent, 2024, runs)


def test_resampling_of_empty_tables(spark, empty, docs, items):
    assert resample.resample(empty, items).collect() == []
    rows = resample.resample(docs, items.where("false")).collect()
    assert len(rows) == docs.count() and all(r["weight"] is not None for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_slot_sharding", "op13_importance_resampling"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(str, cursor.fetchall()))


def test_texts_of_megabytes(spark, items, tmp_path):
    """Longer than a piece of the automaton and than a block of the index; one of them has a word of two megabytes."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(1_500_000)), "the w1 " + "z" * 2_000_000 + " w2 w2", "w1 w2 the"]
    assert len(texts[0]) > words.PIECE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [tuple(r) for r in items.collect()]
    got = lexical.search(lexical.index(docs, str(tmp_path / "i"), block_bytes=1 << 20), items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(list(enumerate(texts)), rows)
    assert sorted(str(tuple(r)) for r in resample.resample(docs, items, percent=50).collect()) == drawn(list(enumerate(texts)), [t for _, t in rows], 50, 2024)
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in slots.shard(docs, shards=2).collect()}
    assert sizes == {i: (len(t) + 8, zlib.crc32(t.encode())) for i, t in enumerate(texts)}

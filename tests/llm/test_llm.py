"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import json
import math
import os
import random
import tracemalloc
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import batches, chat, langid, lm, neardup, packing, pii, piece, quality, records, spots
from palimpsest.llm.queries import BYTE_BPE, ORACLES, PIECE_BPE, QUERIES

SF = "/root/testdata/sf0.001"

SYLLABLES = ["the", "an", "ti", "on", "re", "sh", "ing", "ou", "der", "le", "ß", "é"]
ODD = [None, "", " ", "\n\n", "a", "a  b", "it's\t'tis  <|endoftext|>  x\n y", "☃😀  é\x00 ▁▁x", "<s> <0x41> </s> \\ </turn>", "the the the " * 3000, "x" * 5000, "ab " * 9000 + "token = \"0123456789abcdef0123456789abcdef01234567\""]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ",", ".", "&&&"])
    made = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(60)]
    near = [" ".join(w if rng.random() > 0.01 else "zz" for w in made[i].split()) for i in range(20)]
    return ODD + made + near + made[:5]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns clash with the operators' own names; one id is null, one row is repeated."""
    rows = [(i, t, "en" if i % 2 else "fr", "s", "clash", 1.0) for i, t in enumerate(texts)] + [(None, "null id text here now", None, None, "clash", None), (20, texts[20], "en", "s", "clash", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept string, score double")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parity_pair(n: int) -> tuple[str, str]:
    """Two texts over a and b that any polynomial in an odd base modulo 2^64 takes for one (from 1,024 letters on)."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_span_hashes_tell_texts_apart():
    rng = random.Random(1)
    made = {"".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 40, 1024, 5000]))) for _ in range(4000)}
    made |= {t for n in (1024, 2048, 4096) for t in parity_pair(n)} | {"a" * n for n in range(1, 300)} | {"\0" * n + "a" for n in range(40)}
    words = sorted(made)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    for lane in (0, 1):
        h = batches.span_hashes(data, ends - [len(w) for w in words], ends, lane)
        assert len(set(h.tolist())) == len(words)
        for i in range(0, len(words), 37):  # the same at any offset
            raw = np.frombuffer(("x" * (i % 11) + words[i]).encode(), np.uint8)
            assert batches.span_hashes(raw, np.array([i % 11]), np.array([len(raw)]), lane)[0] == h[i]


def test_span_hashes_of_one_long_span(monkeypatch):
    data = np.random.default_rng(0).integers(0, 256, 100_003).astype(np.uint8)
    whole = batches.span_hashes(data, np.array([5]), np.array([100_001]))
    monkeypatch.setattr(batches, "PIECE_BYTES", 1000)
    assert (batches.span_hashes(data, np.array([5]), np.array([100_001])) == whole).all()


def test_texts_that_a_polynomial_confuses(spark):
    """As words, lines and shingles: counted, found and linked as the different texts they are."""
    for n in (1024, 2048):
        a, b = parity_pair(n)
        docs = spark.createDataFrame([(0, a), (1, b), (2, f"{a}\n{b}"), (3, f"{a}\n{b}\n{a}")], "doc_id long, text string")
        near = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
        assert near == {0: 0, 1: 1, 2: 2, 3: 3}
        got = {r["doc_id"]: r for r in quality.quality_rules(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()}
        assert [got[i]["n_dup_lines"] for i in range(4)] == [0, 0, 0, 1]
        model, counts = lm.fit(docs)
        assert counts.count() == 3 and sorted(r["n"] for r in counts.collect()) == [3, 4, 4]


def test_lm(spark, docs, empty):
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 0
    known = [r for r in docs.collect()]
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for r in known if (r["doc_id"] or 0) % 3 for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    for bound in (1 << 17, 50):  # the bound on frequent words changes no count
        model, counts = lm.fit(docs.where(~held), known=bound)
        got = lm.score(docs, model, counts, held).collect()
        assert len(got) == len(known)
        want = Counter((r["doc_id"], len(tokens(r["text"])), sum(c[w] > 0 for w in tokens(r["text"])), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r["text"])), 4)) for r in known)
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["train_tokens"] == n for r in got)
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])
    none, counts = lm.fit(empty)
    assert lm.score(empty, none, counts, F.lit(True)).count() == 0
    assert {r["n_known"] for r in lm.score(docs, none, counts, F.lit(True)).collect()} == {0}


@pytest.mark.parametrize("known,own,levels", [(300, 300, 0), (300, 300, 1), (300, 40, 1), (7, 7, 2), (330, 0, 1), (1, 1, 1)])
def test_lm_is_a_distribution(known, own, levels):
    """Over all words and one unknown at the end of each row of hash digits, whatever the weights."""
    rng = np.random.default_rng(known + levels)
    words = rng.integers(0, 1 << 63, 330).astype(np.uint64) * np.uint64(2)
    counts = np.sort(rng.integers(1, 50, 330))[::-1]
    rare = np.ones(lm.WAYS**levels)
    head = lambda w: (w >> np.uint64(64 - 4 * levels)).astype(int) if levels else np.zeros(len(w), int)
    np.add.at(rare, head(words[own:]), counts[own:] + 1)
    model = lm.Model.start(words[:known], counts[:known], own, int(counts.sum()), 330, rare, 10)
    model.tables = [rng.normal(size=t.shape).astype(np.float32) / 3 for t in model.tables]
    model.ready()
    unknown = (np.arange(len(rare)).astype(np.uint64) << np.uint64(64 - 4 * levels) if levels else np.zeros(1, np.uint64)) + np.uint64(1)
    total = 0.0
    for w, c in zip([*words, *unknown], [*counts, *[0] * len(unknown)]):
        rank, value = model.log_probabilities(np.array([words[3], words[9], w]), np.zeros(3, int))
        total += np.exp(value[2]) * (1 if 0 <= rank[2] < own else (c + 1) / rare[head(np.array([w]))[0]])
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_scores_long_texts_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    model = lm.Model.start(words, np.arange(200, 0, -1), 150, 20100, 200, np.ones(16), 10)
    model.tables = [rng.normal(size=t.shape).astype(np.float32) for t in model.tables]
    model.ready()
    hashes, rows = np.append(words, 5 + words[:40])[rng.zipf(1.4, 5000) % 240], np.repeat([0, 1, 2], [10, 4900, 90])
    whole = model.log_probabilities(hashes, rows)[1]
    monkeypatch.setattr(lm, "PIECE", 64)
    assert np.allclose(model.log_probabilities(hashes, rows)[1], whole, atol=1e-5)


def test_lm_learns_by_the_gradient():
    """One step moves the tables against the derivative of the loss, row by row."""
    rng = np.random.default_rng(3)
    model = lm.Model.start(rng.integers(0, 1 << 63, 50).astype(np.uint64), np.arange(50, 0, -1), 50, 1275, 50, np.ones(1), 10).ready()
    _, token, node, digit, cells = model.choices(model.words[rng.integers(0, 50, 30)], np.zeros(30, int))
    loss = lambda: -model.forward(node, digit, cells)[0].astype(float).sum()
    before = [t.copy() for t in model.tables]
    squares, moved = [np.full(1 << 10, 1e12, np.float32) for _ in before], [np.zeros(1 << 10, np.int64) for _ in before]
    model.learn(node, digit, cells, squares, moved)
    change = [t - z for t, z in zip(model.tables, before)]
    assert sum(int(m.sum()) for m in moved) == lm.FEATURES * len(node)
    for f in range(lm.FEATURES):
        row = cells[5, f]
        for c in (0, 3, 9):
            model.tables = [t.copy() for t in before]
            model.tables[f][row, c] += 1e-2
            up = loss()
            model.tables[f][row, c] -= 2e-2
            assert (up - loss()) / 2e-2 == pytest.approx(-change[f][row, c] / lm.RATE * 1e6, abs=2e-2)


def test_lm_learns_in_the_same_space():
    """Once it has learned from as many choices, a step makes no new array of their classes."""
    rng = np.random.default_rng(4)
    model = lm.Model.start(rng.integers(0, 1 << 63, 500).astype(np.uint64), np.arange(500, 0, -1), 500, 125250, 500, np.ones(1), 17).ready()
    _, _, node, digit, cells = model.choices(model.words[rng.integers(0, 500, 20_000)], np.zeros(20_000, int))
    squares, moved = [np.ones(1 << 17, np.float32) for _ in model.tables], [np.zeros(1 << 17, np.int64) for _ in model.tables]
    model.learn(node, digit, cells, squares, moved)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    try:
        model.learn(node, digit, cells, squares, moved)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert peak < 2 * len(node) * lm.WAYS * 4  # indexes, but neither logits, probabilities, gathered rows nor sums


@pytest.mark.parametrize("bits", [10, 16, 17, 18])
def test_lm_rows_are_sorted_stably(bits):
    index = np.random.default_rng(bits).integers(0, 1 << bits, 50_000).astype(np.uint16 if bits <= 16 else np.uint32)
    assert (lm._by_row(index) == np.argsort(index, kind="stable")).all()
    assert (lm._by_row(np.sort(index)) == np.arange(len(index))).all()


@pytest.mark.parametrize("far", [1.0, 60.0, 300.0])
def test_lm_weights_far_out(far):
    """Log probabilities by plain computation, where exponentials leave float32 too."""
    rng = np.random.default_rng(5)
    model = lm.Model.start(rng.integers(0, 1 << 63, 300).astype(np.uint64), np.arange(300, 0, -1), 300, 45150, 300, np.ones(1), 10)
    for shift in (-far, far):
        model.tables = [(rng.normal(size=t.shape) + shift).astype(np.float32) for t in model.tables]
        model.ready()
        _, _, node, digit, cells = model.choices(model.words[rng.integers(0, 300, 6000)], np.zeros(6000, int))
        z = model.bias[node].astype(float) + sum(model.tables[f][cells[:, f]].astype(float) for f in range(lm.FEATURES))
        z -= z.max(axis=1, keepdims=True)
        want = z[np.arange(len(z)), digit] - np.log(np.exp(z).sum(axis=1))
        value, p = model.forward(node, digit, cells)
        assert np.allclose(value, want, atol=2e-3) and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_lm_updates_are_packed_without_loss():
    """What a task sends: rarely moved rows, small changes. Each number comes back, in fewer bytes."""
    rng = np.random.default_rng(6)
    weight, change = rng.zipf(1.5, 4096).clip(0, 1 << 20).astype(np.float32), (rng.normal(size=4096 * lm.WAYS) / 8).astype(np.float16)
    for numbers in (weight, change, np.array([0.0, -0.0, np.inf, 1e-7], np.float16), np.zeros(4096, np.float32)):
        assert lm.unpacked(lm.packed(numbers), numbers.dtype, len(numbers)).tobytes() == numbers.tobytes()
    assert len(lm.packed(weight)) + len(lm.packed(change)) < 0.9 * (weight.nbytes + change.nbytes)


@pytest.mark.parametrize("n,distinct", [(1, 1), (5000, 3), (4000, 900), (700, 700), (4096, 1)])
def test_run_sums(n, distinct):
    rng = np.random.default_rng(n)
    rows = np.sort(rng.zipf(1.3, n) % distinct)
    values = rng.normal(size=(64, 5))
    source = rng.integers(0, 64, n)
    sums, first = lm._run_sums(values, source, np.concatenate([[True], rows[1:] != rows[:-1]]))
    assert sorted(rows[first]) == sorted(set(rows))
    for total, row in zip(sums, rows[first]):
        assert np.allclose(total, values[source[rows == row]].sum(axis=0))


def spark_hash(*values) -> int:
    """Spark's xxhash64 of strings and longs, from the published algorithm."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def brute_signatures(text: str) -> list[int]:
    """Spot signatures as a plain walk over the words."""
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split(" ")
    words = [w for w in words if w]
    common = set(spots.COMMON)
    content = [w for w in words if w not in common]
    out, behind = set(), 0
    for w in words:
        if w in common:
            if behind + spots.CHAIN <= len(content):
                out.add(spark_hash(w, spark_hash(*content[behind : behind + spots.CHAIN])))
        else:
            behind += 1
    if not out and text:
        out = {spark_hash(*words[i : i + 3]) for i in range(len(words) - 2)} or {spark_hash(text)}
    return sorted(out)


def test_spots(spark, docs, empty, texts, monkeypatch):
    monkeypatch.setattr(spots, "BUCKET_ROWS", 9)
    long_runs = [" ".join(["the of and"] * 40 + ["big house"] + ["in der"] * 30 + ["one tree two"]), "the of", "big the of", "the big", "El Niño y la niña, más!"]
    more = spark.createDataFrame([(200 + 100 * i, t) for i, t in enumerate(long_runs)] + [(900, texts[40]), (1000, texts[40] + " end"), (7, None), (7, ""), (7, "seven"), *[(77, f"hot {i} the a b") for i in range(60)], *[(None, f"no id {i} of c d") for i in range(40)]], "doc_id long, text string")
    every = docs.select("doc_id", "text", F.lit("clash").alias("__plain"), F.lit("c").alias("class_id")).unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"] or "") for r in every.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]), r[1].encode()), reverse=True)
    sigs = {t: brute_signatures(t) for _, t in rows}
    like = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    shown = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
    in_class = [(i, t) for i, t in rows if i is not None and t]
    want = Counter()
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        own = min(j for j, u in in_class if sigs[u] == sigs[t]) if i is not None and t else None
        e = brute_signatures(edited)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(sigs[t]), shown(e), round(like(sigs[t], e), 9), round(like(sigs[t], sigs[after]), 9), own] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9), r["class_id"]) for r in spots.fingerprint_query(every).collect())
    assert got == want
    assert spots.fingerprint_query(empty).count() == 0


def test_similar_equals_brute_force(spark, docs):
    made = spots.with_signatures(docs.where("text <> '' and doc_id is not null").dropDuplicates(["doc_id"]), "text", "sigs").collect()
    sets = {r["doc_id"]: set(r["sigs"]) for r in made}
    classes, pairs = spots.similar(docs, 0.7)
    name = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    want = {(min(name[a], name[b]), max(name[a], name[b])) for a in sets for b in sets if name[a] != name[b] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert found == want and all((name[a] == name[b]) == (sets[a] == sets[b]) for a in sets for b in sets)


@pytest.mark.parametrize("block", [3, 2048])
def test_similar_sets_of_a_large_bucket(spark, monkeypatch, block):
    """A group of near copies with different texts loses no pair, whole or dealt to a grid."""
    monkeypatch.setattr(spots, "BLOCK", block)
    rng = random.Random(8)
    base = " ".join(f"the w{i} is v{i}" for i in range(60)).split()
    group = [" ".join(w if rng.random() > 0.01 else f"q{rng.randrange(99)}" for w in base) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(group + group[:3])] + [(None, group[0]), (90, None)], "doc_id long, text string")
    sets = {r["doc_id"]: frozenset(r["sigs"]) for r in spots.with_signatures(df.where("text is not null and doc_id is not null"), "text", "sigs").collect()}
    classes, pairs = spots.similar(df, 0.8)
    name = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert name == {d: min(x for x in sets if sets[x] == sets[d]) for d in sets}
    reps = sorted(set(name.values()))
    rows = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} != set()


def test_chat(spark):
    m = lambda *turns: [{"role": r, "content": c} for r, c in turns]
    cases = [  # record, layout, turns
        ({"messages": m(("user", "hi"), ("assistant", "</turn>\n"))}, "messages", [("user", "hi"), ("assistant", "</turn>\n")]),
        ({"messages": m(("human", "hi"), ("bot", "a")), "name": "x", "meta": {"prompt": "p", "messages": [{"role": "z"}]}}, "messages", [("user", "hi"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a", "weight": 1}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        (m(("user", "x")), "turn list", [("user", "x")]),
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o", "tags": ["a", "b"], "score": None}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"system": "s", "instruction": "i", "output": "o"}, "system instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"data": {"messages": m(("model", "z"))}, "source": [[{"messages": 1}]]}, "wrapped messages", [("assistant", "z")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": None}, {"text": "b"}]}]}, "content parts", [("user", "ab")]),
        ({"turns": [{"speaker": "human", "said": "x"}]}, "speaker turns", [("human", "x")]),
        ({"messages": []}, "messages", []),
        # texts that look like structures are texts
        ({"prompt": '{"messages": [{"role": "x", "content": "y"}]}', "completion": '["a", {"prompt": 1}] " \\ : , ]'}, "prompt", [("user", '{"messages": [{"role": "x", "content": "y"}]}'), ("assistant", '["a", {"prompt": 1}] " \\ : , ]')]),
        ({"unknown": 1}, None, None), ({"prompt": "p"}, None, None), ({"data": {"prompt": "p", "completion": "c"}}, None, None), ([], None, None), ({}, None, None), (5, None, None),
    ]
    rows = [(i, json.dumps(r), "clash", "c") for i, (r, _, _) in enumerate(cases)] + [(100, "broken {", "clash", "c"), (101, None, "clash", "c"), (102, json.dumps(cases[0][0], indent=3), "clash", "c")]
    got = {r["i"]: r for r in chat.canonical_turns(spark.createDataFrame(rows, "i int, record string, layout string, __at string")).collect()}
    for i, (_, layout, turns) in [*enumerate(cases), (100, (None, None, None)), (101, (None, None, None)), (102, cases[0])]:
        assert got[i]["layout"] == layout and (got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == turns, cases[i] if i < 100 else i
        assert got[i]["__at"] == "c"
    turns = [(c, i, r, f"{c} {i} {{\"prompt\": [1]}} \\ <turn> é") for c in range(10, 90) for i, r in enumerate([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["human", "bot"]][c % 4])]
    turns += [(0, 0, "user", "\\### Assistant: </turn> ok"), (0, 1, "assistant", "<turn>\\<text>\\\\ é"), (1, 0, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "tie"), (3, None, "we</turn>ird\n", "x" * 70000), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] or 0, t[2] or "", t[3] or ""))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert {r["layout"] for r in got.values()} == {l.name for l in chat.LAYOUTS}
    assert chat.chat_digest(df.limit(0)).count() == 0


def test_chat_keeps_very_long_turns(spark):
    """A turn above the JSON parser's default of 20,000,000 characters, in rows and in a record of another layout."""
    long = F.concat(F.lit("<turn> "), F.repeat(F.lit("y"), 21_000_000))
    rows = spark.range(2).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, F.lit("hi")).otherwise(long).alias("text"))
    text = "<turn> " + "y" * 21_000_000
    got = chat.chat_digest(rows).first()
    assert got["layout"] and got["n_turns"] == 2 and got["loss_chars"] == len(text)
    assert got["turns_sha256"] == hashlib.sha256(f"user\nhi\nassistant\n{text}\n".encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    record = spark.range(1).select(F.to_json(F.struct(F.lit("hi").alias("prompt"), long.alias("completion"))).alias("record"))
    turns = chat.canonical_turns(record).select("layout", F.transform("turns", lambda t: F.length(t["text"])).alias("n")).first()
    assert turns["layout"] == "prompt" and turns["n"] == [2, len(text)]


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for r in piece.sentencepiece_round_trip(docs, PIECE_BPE, keep=["doc_id", "text"], with_ids=True).collect():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert piece.sentencepiece_round_trip(empty, PIECE_BPE).count() == 0


def test_pieces_random():
    rng = random.Random(2)
    coder = piece.BacktrackEncoder.load(PIECE_BPE)
    made = ["".join(rng.choice(" \n\taeiostnrh▁.,'é😀0123/(){}") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(made)] == coder.library.encode(made)


#: The contract's base patterns, word for word.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def contract_spans(t: str) -> list[tuple[str, int, int]]:
    digits = lambda x: re.sub("[^0-9]", "", x)
    odd = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
    out = [("email", *m.span()) for m in re.finditer(EMAIL, t)]
    out += [("ip", *m.span()) for m in re.finditer(IP, t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, t) if 16 <= len(digits(m.group())) <= 19 and odd(digits(m.group())) % 10 == 0]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, t) if 8 <= len(digits(m.group())) <= 15]


def test_pii_base_equals_the_patterns():
    rng = random.Random(1)
    parts = [["a", "b", "@", "@", ".", ".", "-", "+", " ", "1"], ["1", "2", "3", "4", ".", ".", " ", "25"], ["4", "1", "0", " ", "-", "41", "x"], ["+", "+1", "2", "3", "(", ")", " ", ".", "-", "45"], ["4111", "1111", " ", "-", "5", "\n", "+", "x"]]
    hit = Counter()
    for n in range(8000):
        t = "".join(rng.choice(parts[n % 5]) for _ in range(rng.randint(1, 30)))
        want = contract_spans(t)
        assert pii.base_spans(t) == want, t
        hit.update(k for k, _, _ in want)
    assert set(hit) == set(pii.BASE_KINDS) and min(hit.values()) > 20


def test_pii(docs, empty):
    model = pii.default_model()
    cases = {
        "a@b.cc x@y a@@b.c. q.w+e@m-1.example.org": [("email", 0, 6), ("email", 19, 40)],
        "1.2.3.4.5 300.1.1.1 10.0.0.255": [("ip", 0, 7), ("ip", 20, 30)],
        "4111 1111 1111 1111, 4111111111111112": [("card", 0, 19)],
        "+1 (974) 555-3436 and +12": [("phone", 0, 17)],
    }
    for text, want in cases.items():
        assert pii.base_spans(text) == want
    assert pii.find('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', model)[1] == [("secret", 9, 49)]
    assert ("phone", 5, 19) in pii.find("call (974) 555-3436 now", model)[1]
    assert pii.find("we met at noon dot 2024-01-02 12:30:11", model)[1] == []
    text = "iban DE89 3704 0044 0532 0130 00, call 0171-2345678 or 030/1234567"
    assert [(k, text[a:b]) for k, a, b in pii.find(text, model)[1]] == [("phone", "0171-2345678"), ("phone", "030/1234567"), ("account", "DE89 3704 0044 0532 0130 00")]
    rows = pii.personal_data(docs, model, keep=["doc_id", "text"]).collect()
    assert all(r["base_sha256"] == hashlib.sha256(pii.joined(contract_spans(r["text"] or "")).encode()).hexdigest() for r in rows)
    assert all(set(pii.joined(contract_spans(r["text"] or "")).split(",")) - {""} <= set(r["spans"].split(",")) for r in rows)
    cleaned = pii.redact(docs, model)
    assert cleaned.columns == docs.columns and "[SECRET]" in cleaned.where("doc_id = 11").first()["text"]
    assert cleaned.where("doc_id = 0").first()["text"] is None and pii.redact(empty, model).count() == 0


def labellings(n, segments, kinds):
    """All ways to cover ``n`` tokens by segments of a kind and single tokens of none."""
    def walk(at):
        if at == n:
            yield []
            return
        for rest in walk(at + 1):
            yield rest
        for r, (i, j) in enumerate(segments):
            if i == at:
                for rest in walk(j):
                    for k in range(kinds):
                        yield [(r, k), *rest]
    return walk(0)


@pytest.mark.parametrize("seed", range(4))
def test_field_sums_and_best_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    n, kinds = 5, pii._N
    every = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)]
    i, j = np.array([every[x] for x in np.sort(rng.choice(len(every), 4, replace=False))]).T
    model = pii.Field(moves=rng.normal(size=(kinds + 1, kinds + 1)))
    model.moves[kinds, kinds] = 0
    scores = rng.normal(size=(4, kinds)) + 0.5
    scores[0, 1] = -np.inf
    totals, chance, moved, top = [], np.zeros((4, kinds)), np.zeros((kinds + 1, kinds + 1)), (-np.inf, None)
    ways = list(labellings(n, list(zip(i, j)), kinds))
    moves_of = [pii.gold_moves(n, [(i[r], j[r], k) for r, k in way]) for way in ways]
    values = np.array([sum(scores[r, k] for r, k in way) + (m * model.moves).sum() for way, m in zip(ways, moves_of)])
    weights = np.exp(values - np.logaddexp.reduce(values))
    for way, m, w in zip(ways, moves_of, weights):
        moved += w * m
        for r, k in way:
            chance[r, k] += w
    total, got, expected = model.sums(n, i, j, scores)
    assert total == pytest.approx(np.logaddexp.reduce(values)) and np.allclose(got, chance) and np.allclose(expected, moved)
    best = model.best(i, j, scores)
    assert sum(scores[r, k] for r, k in best) + (pii.gold_moves(n, [(i[r], j[r], k) for r, k in best]) * model.moves).sum() == pytest.approx(values.max())
    # the gradient of the log sum is what finite differences give
    for r, k in ((1, 0), (3, 2)):
        step = scores.copy()
        step[r, k] += 1e-5
        assert (model.sums(n, i, j, step)[0] - total) / 1e-5 == pytest.approx(chance[r, k], abs=1e-4)
    for a, b in ((kinds, 2), (0, 0), (1, kinds)):
        other = pii.Field(moves=model.moves.copy())
        other.moves[a, b] += 1e-5
        assert (other.sums(n, i, j, scores)[0] - total) / 1e-5 == pytest.approx(expected[a, b], abs=1e-4)


def test_segments_equal_enumeration():
    """Features by differences of sums are those of each segment on its own."""
    for text, _ in pii._sentences(3, 12):
        t = pii.Tokens([text])
        i, j, cells = t.segments()
        for r in range(0, len(i), 17):
            words = [text[a:b] for a, b in zip(t.start[i[r] : j[r]], t.end[i[r] : j[r]])]
            kinds = t.kind[i[r] : j[r]]
            x = cells[r] - pii._OFFSETS
            assert x[1] == min(20, sum(c.isdigit() for w, k in zip(words, kinds) if k == pii._DIGITS or pii._HEX <= k <= pii._LONG for c in w))
            assert x[2] == min(9, (kinds == pii._DIGITS).sum()) and x[6] == kinds[0] and x[7] == kinds[-1]
            assert x[16] == min(9, max((len(w) for w, k in zip(words, kinds) if k == pii._DIGITS), default=0))
            assert x[18] == min(2, sum(w.lower() == "at" for w in words)) and x[19] == min(3, sum(w.lower() == "dot" for w in words))


def test_pii_finds_planted_data_and_leaves_clean_texts():
    """Recall and precision on sentences that another seed writes, and on real layouts of text."""
    model = pii.default_model()
    cases = pii._sentences(77, 300)
    hit = found = planted = 0
    for (_, spans), (_, got) in zip(cases, pii.find_all([t for t, _ in cases], model)):
        a, b = {s[1:] for s in spans}, {s[1:] for s in got}
        hit, found, planted = hit + len(a & b), found + len(b), planted + len(a)
    assert hit / planted > 0.9 and hit / found > 0.92, (hit, found, planted)


def test_pii_looks_at_the_whole_text():
    """Wherever it stands in a long text, a span is found; so are long ones."""
    model, mixed = pii.default_model(), "ABCDa1b2EFGHi3j4klmn5o6pABCDa7b8hij9"
    assert pii.find("host 10[.]20[.]30[.]40 up", model)[1] == [("ip", 5, 22)]
    assert pii.find("10(dot)0(dot)0(dot)7", model)[1] == [("ip", 0, 20)]
    assert pii.find(f"see {mixed}k ok", model)[1] == [("secret", 4, 41)]
    assert pii.find(f"key = {mixed * 4} end", model)[1] == [("secret", 6, 150)]
    assert pii.find("write joe at " + "a" * 60 + " dot com", model)[1] == [("email", 6, 81)]
    text = "write to jo at a dot b dot c dot d dot e dot f dot org please"
    assert any(k == "email" and "jo at a dot b dot c dot d dot e dot f dot org" in text[a:b] for k, a, b in pii.find(text, model)[1])
    rng = random.Random(3)
    for n in (0, 1, 95, 96, 97, 200, 5000, 80_000):
        fill = "".join(rng.choice(["lo ", "mi ", "\n", "x" * 30 + " "]) for _ in range(n))[:n]
        for made, kind in ((" 10[.]20[.]30[.]40 ", "ip"), (f" {mixed} ", "secret"), (" tel. (974) 555-3436 ", "phone"), (" kim at lomi dot org ", "email")):
            got = pii.find(fill + made + fill, model)[1]
            assert [k for k, a, b in got] == [kind] and fill + made + fill != "", (n, made, got)
            assert len(fill) <= got[0][1] and got[0][2] <= len(fill) + len(made)


def test_redact_leaves_no_rest_of_a_long_key(spark):
    key = "0a1b2c3d" * 30
    df = spark.createDataFrame([(1, f'token = "{key}" end'), (2, "from 10[.]20[.]30[.]40 on")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(df, pii.default_model()).collect()} == {1: 'token = "[SECRET]" end', 2: "from [IP] on"}


def test_pii_takes_time_in_proportion():
    """Long runs and half-written addresses once took quadratic time or more."""
    model, n = pii.default_model(), 60_000
    began = time.time()
    for t in ("1" * n, "abc123" * (n // 6), "x at " + "b dot " * (n // 6), "0123456789abcdef" * (n // 16), "123" + " " * n, "(123) 555-1234 " * (n // 15), "a@" * (n // 2)):
        pii.find(t, model)
    assert time.time() - began < 30
    rng = random.Random(5)
    good = lambda m: all(int(p) <= 255 for p in m.group().split("."))
    for _ in range(3000):
        t = "".join(rng.choice("1234..  255") for _ in range(24))
        assert [s[1:] for s in pii.base_spans(t) if s[0] == "ip"] == [m.span() for m in pii.IP.finditer(t) if good(m)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, empty, k, percent):
    base = " ".join(f"w{i}" for i in range(150)).split()
    rng = random.Random(4)
    group = [" ".join(w if rng.random() > 0.012 else f"q{rng.randrange(99)}" for w in base) for _ in range(120)]  # a diffuse group
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(group)], "doc_id long, text string")
    every = docs.select("doc_id", "text", F.lit(9).alias("n_shingles")).unionByName(more, allowMissingColumns=True)
    sets = {}
    for r in every.where("doc_id is not null").collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(every, k, percent).collect()
    assert len(got) == every.count()
    assert all(r["component_id"] == find(r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (find(r["doc_id"]) == r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(every, k, percent)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([d for d in sets if find(d) == d] + [None])


def test_ids_that_repeat_with_other_texts(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("c")), (2, text("c")), (3, text("a") + " x"), (4, text("b") + " y"), (5, None), (5, ""), (5, None), (None, text("a")), (None, text("a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == Counter([(1, 38, 1, True)] * 2 + [(2, 38, 2, True)] * 2 + [(3, 39, 1, False), (4, 39, 1, False)] + [(5, 0, 5, True)] * 3 + [(None, 38, None, True)] * 2)
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.keep_one(df, 3, 85).collect())
    assert kept == Counter({(1, text("a")): 1, (1, text("b")): 1, (2, text("c")): 1, (5, None): 1, (5, ""): 1, (None, text("a")): 2})


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    """The later rounds alone, with tiny blocks, still find chains of near copies."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    chain = [" ".join(f"v{j}" for j in range(i * 4, i * 4 + 100)) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(chain)], "doc_id long, text string")
    assert {r["component_id"] for r in neardup.near_duplicates(df, 3, 85).collect()} == {0}


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12, 90)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.quality_rules(docs, model, keep=["doc_id", "text"]).collect()
    for r in got:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(empty, quality.fit(empty, labels)).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.2 * rng.normal(size=800) > 0.7).astype(float)
    trees = quality.train(x, y, np.array([1, 0, -1]))
    grid = np.tile(rng.random((50, 3)), (2, 1))
    for j, sign in ((0, 1), (2, -1)):
        a, b = grid[:50].copy(), grid[:50].copy()
        b[:, j] = np.minimum(1, a[:, j] + 0.3)
        assert (sign * (trees.score(b) - trees.score(a)) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.85


def test_records(spark, docs, empty, tmp_path):
    tk = library(BYTE_BPE)
    records.write_records(docs, f"file://{tmp_path}/d", BYTE_BPE, end_id=2, file_bytes=5000)
    records.build_index(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/i")
    index = records.starts(spark.read.parquet(f"file://{tmp_path}/i"))
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"file://{tmp_path}/d")
    longest = index.agg(F.max("record_bytes")).first()[0]
    assert files.count() > 10 and files.agg(F.max("length")).first()[0] < 5000 + longest
    at = 0
    for r, g in zip(rows, index.orderBy("start").collect(), strict=True):
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = {r["doc_id"]: r["ids"] for r in records.read_records(spark, f"file://{tmp_path}/d", index.where("doc_id in (3, 6, 40)")).collect()}
    assert some == {i: tk.encode(next(r["text"] for r in rows if r["doc_id"] == i), add_special_tokens=False).ids + [2] for i in (3, 6, 40)}
    # the same where no Python file system knows the path
    opener, records._opener = records._opener, lambda path: None
    assert {r["doc_id"]: r["ids"] for r in records.read_records(spark, f"file://{tmp_path}/d", index.where("doc_id in (3, 6, 40)")).collect()} == some
    records._opener = opener
    with pytest.raises(ValueError, match="70000"):
        records.frame(1, np.array([3, 70000], "<u4").tobytes(), 2)
    assert records.parse(records.frame(1, np.array([3, 70000], "<u4").tobytes(), 4) + b"\n")[1].tolist() == [3, 70000]
    raw = bytearray(records.frame(5, np.array([1, 2, 3], "<u4").tobytes(), 2) + b"\n")
    assert records.parse(bytes(raw))[0] == 5
    raw[25] ^= 1
    with pytest.raises(ValueError):
        records.parse(bytes(raw))
    assert records.token_records(docs.where("doc_id = 1"), BYTE_BPE).first()["n_tokens"] == 1
    assert records.token_records(empty, BYTE_BPE).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(3)
    words = {"en": "the and of with from ing house tion".split(), "de": "der und zu schön keit nicht ein haus".split(), "fr": "le et été de que eaux où dans".split(), "es": "el y ñandú de que ción para los".split()}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(rng.randint(8, 60))), l) for i, l in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 1"))
    assert {f for f, _, _ in model.families} == {"germanic", "romance"} and set(model.pairs) == {("de", "en"), ("es", "fr")}
    test = df.where("doc_id % 3 = 1")
    got = langid.identify(test.withColumn("lang_pred", F.lit("clash")), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model, keep=["doc_id"]).collect()}
    assert [odd[i] for i in (0, 1, 2, 3)] == ["und"] * 4 and odd[4] != "und"
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"} and langid.identify(empty, model).count() == 0


def check_packing(rows, table):
    """Each id of each document in exactly one piece, pieces gapless in sequences of 1024 at most, little padding."""
    tk, want = library(BYTE_BPE), Counter()
    for i, t in table:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)] += 1
    bins, documents = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r)
        documents.setdefault(r["doc_id"], []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in b] == [sum(x["length"] for x in b[:i]) for i in range(len(b))] and sum(r["length"] for r in b) <= 1024
    ids_of: dict = {}
    for i, t in table:
        ids_of.setdefault(i, []).append(np.array(tk.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    assert set(documents) == set(ids_of)
    for i, pieces in documents.items():
        # the pieces of each of the documents of an id chain from 0 to its end
        left = list(ids_of[i])
        for ids in left:
            at = 0
            while at < len(ids):
                n = next(k for k, r in enumerate(pieces) if r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()))
                at += pieces.pop(n)["length"]
        assert not pieces
    total = sum(n * c for (_, _, n), c in want.items())
    return total, len(bins)


def test_packing(docs, empty, spark):
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    total, bins = check_packing(packing.harmonic_pack(docs, BYTE_BPE).collect(), table)
    assert bins <= total / 1024 * 1.1 + 8 * docs.rdd.getNumPartitions()
    assert packing.harmonic_pack(empty, BYTE_BPE).count() == 0
    assert all(sum(packing.cut(n, 1024)) == n for n in range(1, 5000))
    rng = random.Random(5)
    many = [(i, " ".join(rng.choice(SYLLABLES) for _ in range(int(rng.paretovariate(0.8) * 20) % 6000))) for i in range(1500)]
    total, bins = check_packing(packing.harmonic_pack(spark.createDataFrame(many, "doc_id long, text string").coalesce(1), BYTE_BPE).collect(), many)
    assert total / 1024 / bins > 0.97  # of all places


def near_roots(table, k, percent):
    """Smallest reachable id of each id, by all pairs; rows are (id, text), ids unique."""
    sets = {}
    for i, t in table:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[x : x + k]) for x in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_pipeline(spark, docs, empty, texts, tmp_path):
    """Each stage against a plain computation of its rows from its own input."""
    import corpus_pipeline

    spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(12, 90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    base = " ".join(f"w{i} of" for i in range(100)).split()
    rng = random.Random(6)
    near = [(500 + i, " ".join(w if rng.random() > 0.004 else f"q{rng.randrange(99)}" for w in base)) for i in range(12)] + [(600, "call (974) 555-3436 or write a@b.cc and " + " ".join(f"z{i} the" for i in range(30)))]
    table = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(i, t, "en", "s") for i, t in near], "doc_id long, text string, lang string, source string"))
    table.withColumn("n_chars", F.length("text").cast("long")).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    at, dir_ = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    rows = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "pii", "packing"]

    found = stages["language_id"](spark, at, dir_)
    assert found.columns == corpus_pipeline.COLUMNS and {r["lang"] for r in found.collect()} <= {"en", "fr"}
    assert rows(found) == Counter({(i, t): n for (i, t), n in rows(at).items() if t and any(c.isalpha() for c in t)})

    good = stages["quality_rules"](spark, found, dir_)
    trees, cut = quality.fit(found, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def verdict(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        x, total = quality.statistics(pa.array([t]))[1][0], trees.base
        for node in trees.roots:  # one tree after the other, node by node
            while trees.left[node] != node:
                node = trees.left[node] + (x[trees.feature[node]] > trees.threshold[node])
            total += trees.value[node]
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and 1 / (1 + math.exp(-total)) >= cut

    assert rows(good) == Counter({(i, t): n for (i, t), n in rows(found).items() if verdict(t)}) and 0 < len(rows(good)) < len(rows(found))

    one = stages["near_dedup"](spark, good, dir_)
    root = near_roots([x for x in rows(good) if x[0] is not None], 5, 80)
    assert rows(one) == Counter({(i, t): 1 if i is not None else n for (i, t), n in rows(good).items() if i is None or root[i] == i}) and any(root[i] == 500 for i in range(501, 512) if i in root)

    clean = stages["pii"](spark, one, dir_)
    model = pii.default_model()

    def redacted(t):
        out, at_ = "", 0
        for k, a, b in sorted(pii.find(t, model)[1], key=lambda s: (s[1], -s[2])):
            if a >= at_:
                out += t[at_:a] + f"[{k.upper()}]"
            at_ = max(at_, b)
        return out + t[at_:]

    assert rows(clean) == Counter({(i, redacted(t)): n for (i, t), n in rows(one).items()}) and clean.columns == corpus_pipeline.COLUMNS
    assert "call [PHONE] or write [EMAIL] and" in next(t for i, t in rows(clean) if i == 600)

    packed = stages["packing"](spark, clean, dir_)
    check_packing(packed.collect(), list(rows(clean).elements()))
    piece_ = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    assert piece_(corpus_pipeline.run(spark, dir_)) == piece_(packed)


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty.drop("kept", "score").withColumn("n_chars", F.lit(0).cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_at_the_pipelines_setting(spark):
    """Recall of links at five words and 80 percent on a whole table: components equal those of all pairs."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    root = near_roots([tuple(r) for r in table.collect()], 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table, 5, 80).collect()}
    assert got == root and len(set(root.values())) < len(root)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())

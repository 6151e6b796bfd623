"""The registered queries of this subpackage. Each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from palimpsest.llm import chat, langid, lexical, lm, neardup, packing, pii, piece, quality, records, resample, slots, spots

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(column: str, n: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = _remainder("doc_id", 7) == 2
    model, counts = lm.fit(docs.where(~held_out))
    return lm.score(docs, model, counts, held_out)


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprint_query(_docs(spark, sf_dir))


#: A conversation with control strings in its texts.
EXTRA = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return chat.chat_digest(rows.unionByName(extra))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.sentencepiece_round_trip(_docs(spark, sf_dir), PIECE_BPE, keep=["doc_id"])


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_docs(spark, sf_dir), pii.default_model(), keep=["doc_id"])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, sf_dir), shingle=3, similarity=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs, model, keep=["doc_id"])


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(_docs(spark, sf_dir), BYTE_BPE, end_id=2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = langid.fit(docs.where(_remainder("doc_id", 3) != 1))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(_docs(spark, sf_dir), BYTE_BPE)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard(_docs(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_spot_signatures, op3_chat_format, op4_sentencepiece, op5_personal_data, op6_near_duplicates, op7_quality_rules, op8_token_records, op9_language_id, op10_harmonic_packing, op11_ranked_search, op12_slot_sharding, op13_importance_resampling)}
#: DuckDB SQL of the formatting query: turns and loss text as the contract words them, lengths by the template's escaping, layouts by the rule of ``records_of_turns``.
_LISTED, _PAIRED = ("[" + ", ".join(f"'{x}'" for x in names) + "]" for names in (chat.LIST_LAYOUTS, chat.PAIR_LAYOUTS))
_CHAT_SQL = rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}'),
e AS (SELECT *, length(regexp_replace(replace(role || chr(0) || text, '\', '\\'), '<(/?(?:turn|text)>)', '<\\\1', 'g')) - 1 AS escaped FROM r),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, sum(escaped + {len(chat.OPEN + chat.TEXT + chat.CLOSE) + 1}) AS chars,
  list(role ORDER BY turn NULLS FIRST, role, text) AS roles, first(text ORDER BY turn NULLS FIRST, role, text) AS opening,
  bool_or(role IN ({", ".join(f"'{x}'" for x in chat.ROLES)})) AS other, coalesce(CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 4) AS BIGINT), 0) AS dealt FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
  CASE WHEN other THEN 'speaker turns' WHEN roles = ['user', 'assistant'] AND dealt % 2 = 0 THEN {_PAIRED}[(dealt // 2) % {len(chat.PAIR_LAYOUTS)} + 1]
  WHEN roles = ['system', 'user', 'assistant'] AND opening <> '' AND dealt % 2 = 0 THEN 'system instruction' ELSE {_LISTED}[(dealt // 8) % {len(chat.LIST_LAYOUTS)} + 1] END AS layout FROM g"""
#: DuckDB SQL of the near-duplicate query: full sets compared by shared shingles, and their closure.
_NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM w),
c AS MATERIALIZED (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS rep FROM s),
x AS (SELECT doc_id AS rep, n, unnest(s) AS shingle FROM c WHERE doc_id = rep),
l AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT DISTINCT rep AS node, rep AS far FROM c UNION SELECT r.node, l.b FROM r JOIN l ON r.far = l.a),
m AS (SELECT node AS rep, min(far) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c JOIN m USING (rep)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL of the search query: every posting scored, then ranked.
_SEARCH_SQL = f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id), a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, a GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), a GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 10"""
#: CRC-32 in SQL, from the list of a value's bytes.
_CRC_SQL = """bits AS (SELECT i, i AS c, 0 AS step FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8),
crc_table AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM bits WHERE step = 8),
hexes AS (SELECT list(lpad(upper(to_hex(i)), 2, '0') ORDER BY i) AS h FROM range(256) r(i))"""
_crc_sql = lambda bytes_: f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({bytes_}, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), CAST(4294967295 AS BIGINT))"
_bytes_sql = lambda text: f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS INTEGER))"
#: DuckDB SQL of the resampling query.
_RESAMPLE_SQL = f"""WITH RECURSIVE {_CRC_SQL}, d AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), b AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
k AS (SELECT word, CAST({_crc_sql(_bytes_sql('word'))} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM d UNION ALL SELECT word FROM b)), crc_table),
s AS (SELECT bucket, count(*) AS s FROM d JOIN k USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM d JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight FROM documents LEFT JOIN f USING (doc_id)),
x AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM x)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM r"""
#: DuckDB SQL of the sharding query: slots dealt out in turn, then one edit of the map, slot by slot, for maps without a heavy slot.
_SHARD_SQL = f"""WITH RECURSIVE {_CRC_SQL}, d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_crc_sql(_bytes_sql('text'))} END AS BIGINT) AS text_crc32 FROM documents, crc_table),
v AS MATERIALIZED (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32), 1, 4) AS INTEGER) % {slots.SLOTS} AS INTEGER) AS virtual_slot FROM d),
sums AS (SELECT i AS slot, coalesce(sum(size), 0) AS bytes, i % {slots.SHARDS} AS shard FROM range({slots.SLOTS}) r(i) LEFT JOIN v ON i = virtual_slot GROUP BY i),
run AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, slot) * {slots.SHARDS} <= sum(bytes) OVER () AS within FROM sums),
cut AS (SELECT *, NOT bool_and(within) OVER (PARTITION BY shard ORDER BY bytes DESC, slot) AS free FROM run),
moved AS MATERIALIZED (SELECT slot, bytes, row_number() OVER (ORDER BY bytes DESC, slot) AS i FROM cut WHERE free),
loads AS (SELECT list(b ORDER BY shard) AS l FROM (SELECT shard, CAST(coalesce(sum(bytes) FILTER (NOT free), 0) AS BIGINT) AS b FROM cut GROUP BY shard)),
lpt AS (SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS slot, CAST(-1 AS BIGINT) AS shard, l FROM loads
  UNION ALL SELECT m.i, m.slot, CAST(list_position(l, list_min(l)) - 1 AS BIGINT), list_transform(l, lambda x, j: CASE WHEN j = list_position(l, list_min(l)) THEN CAST(x + m.bytes AS BIGINT) ELSE x END) FROM lpt JOIN moved m ON m.i = lpt.i + 1),
map AS (SELECT slot, shard FROM cut WHERE NOT free UNION ALL SELECT slot, shard FROM lpt WHERE i > 0)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS LAST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot, CAST(1 AS INTEGER) AS map_version
FROM v JOIN map ON virtual_slot = map.slot"""
#: Trained models, hash functions and tokenizers of the other queries are beyond SQL; tests hold those against brute force and the libraries.
ORACLES: dict[str, str] = {"op3_chat_format": _CHAT_SQL, "op6_near_duplicates": _NEAR_SQL, "op11_ranked_search": _SEARCH_SQL, "op12_slot_sharding": _SHARD_SQL, "op13_importance_resampling": _RESAMPLE_SQL}

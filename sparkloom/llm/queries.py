"""The operators' registered queries: each one applies an operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quantization, bpe, chat_format, code_compression, conversation_repair, embedding_dedup, language_id, license_scan, ngram_join, packing, quality, rank_bpe, toxicity
from .common import crc32_mod, table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantization.nearest(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(50)) == 0, k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '<|im_end|><|im_start|>assistant ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    turns = chat_format.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat_format.canonical_turns(probe))
    back = chat_format.read_back(chat_format.format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, lambda i: crc32_mod(i, 5) != 0)
    return language_id.identify(docs, model).select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", lambda i: crc32_mod(i, 4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", lambda i: crc32_mod(i, 3) != 1)
    out = quality.score(docs, model)
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc32(packing.pack_documents(table(spark, sf_dir, "documents")))


def op11_rank_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank_bpe.rank_round_trip(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_all(table(spark, sf_dir, "conversations"))


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = code_compression.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    out = code_compression.with_label_error(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(code_compression.codebook_digest(books)).alias("codebooks_sha256"))


def with_crc32(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_license_scan, op3_bpe_round_trip, op4_chat_format, op5_embedding_dedup, op6_ngram_join, op7_language_id, op8_toxicity, op9_quality, op10_packing, op11_rank_bpe_round_trip, op12_conversation_repair, op13_code_compression)}

_OP4 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || escaped || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

# All pairs, and everything that links lead to: for small tables.
_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(coalesce(low, vec_id), vec_id) AS component_id, least(coalesce(low, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN parts ON parts.a = vec_id"""

_OP6 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
each_ AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM each_ a JOIN each_ b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(coalesce(low, doc_id), doc_id) AS component_id FROM sets LEFT JOIN parts ON parts.a = doc_id"""

def _nearest_sql(n: int) -> str:
    """Each part with its nearest entry of the codebooks b{n}, ties to the lower one."""
    return f"""n{n} AS MATERIALIZED (SELECT a.row, a.p, arg_min(b.k, (f, b.k)) AS k, min(f) AS far FROM parts a JOIN b{n} b USING (p),
  LATERAL (SELECT list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS f) GROUP BY a.row, a.p)"""


def _moved_sql(n: int) -> str:
    """The codebooks after round n: floors of means, unused entries as before."""
    return f"""s{n} AS (SELECT p, k, i, sum(x)::BIGINT AS s, count(*) AS c FROM (SELECT p, k, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM parts JOIN n{n} USING (row, p)) GROUP BY p, k, i),
m{n} AS (SELECT p, k, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x FROM s{n} GROUP BY p, k),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (p, k))"""


# All parts with all entries, two rounds and the last assignment; vectors of one length that 16 divides.
_OP13 = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM kept, range(16) r(p)),
b0 AS MATERIALIZED (SELECT p, row - 1 AS k, x FROM parts WHERE row <= 64),
{_nearest_sql(0)}, {_moved_sql(0)}, {_nearest_sql(1)}, {_moved_sql(1)}, {_nearest_sql(2)},
e AS (SELECT row, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM n2 GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN kept USING (row), h"""

def _edits_sql() -> str:
    """Best lists of edits from row i on, out of each state, from the best ones behind it (r0 to r3: cost, audit, text)."""
    due, to = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
    kept = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    edit = lambda cost, letter, said, q: f"{{'c': {cost} + r{q}.c, 'a': '{letter}' || r{q}.a, 'o': {said} || r{q}.o}}"
    base = []
    for q in range(4):
        keep = " ".join(f"WHEN initial = '{k}' THEN {edit('late', 'K', 'role || chr(58) || text || chr(10)', n)}" for k, n in kept[q].items())
        stay = f"CASE WHEN must_go THEN NULL {keep} END"
        again = f"CASE WHEN NOT must_go THEN {edit('2 + late', 'R', f"'{due[q]}:' || text || chr(10)", to[q])} END"
        base.append(f"list_min(list_filter([{edit('3', 'D', "''", q)}, {stay}, {again}], lambda x: x IS NOT NULL)) AS b{q}")
    put = lambda q, x: f"{{'c': 2 + {x}.c, 'a': 'I' || {x}.a, 'o': '{due[q]}:' || chr(10) || {x}.o}}"
    once = ", ".join(f"list_min([b{q}, {put(q, f'b{to[q]}')}]) AS d{q}" for q in range(4))
    twice = ", ".join(f"list_min([d{q}, {put(q, f'd{to[q]}')}]) AS r{q}" for q in range(4))
    return f"SELECT g, n, i - 1 AS i, {twice} FROM (SELECT *, {once} FROM (SELECT best.g, best.n, best.i, {', '.join(base)} FROM best JOIN f ON f.g = best.g AND f.i = best.i - 1 ))"


# The remainders of all bytes, and the checksum of an ASCII text by them.
_CRC_TABLE = "SELECT list(list_reduce(list_prepend(t::UBIGINT, list_transform(range(8), lambda z: 0::UBIGINT)), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY t) AS of_byte FROM range(256) r(t)"
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda x: unicode(x)::UBIGINT)), lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"

_OP12 = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
t AS ({_CRC_TABLE}),
h AS MATERIALIZED (SELECT c.*, {_CRC} % 20 AS hit FROM c, t),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, range(2) r(k) WHERE hit <> 0 AND (k = 0 OR hit = 3)),
o AS (SELECT *, coalesce(conv_id::VARCHAR, '') AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
e AS (SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final_, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
f AS MATERIALIZED (SELECT *, CASE WHEN final_ = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final_ NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, fault IN ('blank', 'duplicate') AS must_go, (fault = 'truncated')::BIGINT AS late,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM e),
best AS (SELECT g, n, n + 1 AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS r0, {{'c': 4::BIGINT, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS r1, {{'c': 2::BIGINT, 'a': 'I', 'o': 'assistant:' || chr(10)}} AS r2, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS r3 FROM (SELECT g, count(*) AS n FROM f GROUP BY g)
  UNION ALL {_edits_sql()}),
s AS (SELECT conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id, g)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(r0.c, 0) AS cost, coalesce(r0.a, '') AS audit, sha256(coalesce(r0.o[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.g = s.g AND best.i = 1"""

ORACLE_SQL = {"op12_conversation_repair": _OP12, "op13_code_compression": _OP13, "op2_license_scan": license_scan.scan_sql(), "op4_chat_format": _OP4, "op5_embedding_dedup": _OP5, "op6_ngram_join": _OP6}

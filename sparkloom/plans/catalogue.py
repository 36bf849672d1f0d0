"""Registered queries of the operators, and the SQL (DuckDB) that must give the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import epochs, rewards, sequences, training
from ..functions import text as t
from ..operators import bpe_training, dedup, filters, packing, rollouts, tasks, tokenizer
from ..operators import code_exec
from ..sources import logs, readers, shares, writers
from ..sources.checkpoint import drop_table, materialize, shared_folder

WS, LB = t.WS, t.LB
NUM_PERM, BANDS, ROWS, K, THRESHOLD = 16, 8, 2, 5, 0.8
CODE_SOURCES = ("src0", "src1", "src2", "src3", "src4")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    """Documents with a kind, which the tables lack: some sources count as code. Files of one row group are dealt out."""
    docs = _t(spark, d, "documents").select("doc_id", "text", "source", F.when(F.col("source").isin(*CODE_SOURCES), "code").otherwise("prose").alias("kind"))
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _r(c, n=6):
    return F.round(c, n)


# --- text features and quality rules

def quality_features(spark, d):
    # White space is normalised once, by a generator of one row, which the optimiser doesn't write into each feature.
    docs = _docs(spark, d).select("doc_id", "text", F.explode_outer(F.array(t.normalise_space(F.col("text")))).alias("normal"))
    docs = docs.select("doc_id", "text", F.length("normal").alias("n_normal"), t.count_words(F.col("normal")).alias("n_words"), t.inked(F.col("normal")).alias("inked"), t.symbol_count(F.col("text")).alias("n_symbols"))
    x, words = F.col("text"), F.nullif(F.col("n_words"), F.lit(0))
    return docs.select("doc_id", F.length(x).alias("n_chars"), "n_words", _r(F.col("inked") / words).alias("mean_word_len"), "n_symbols", _r(F.col("n_symbols") / words).alias("symbol_ratio"), _r(t.alpha_fraction(x)).alias("alpha_fraction"), _r(t.alnum_fraction(x)).alias("alnum_fraction"), _r(t.duplicate_line_fraction(x)).alias("dup_line_fraction"), _r(t.mean_line_length(x)).alias("mean_line_len"), "n_normal")


_FEATURES = f"""
WITH l AS (SELECT *, regexp_split_to_array(text, '{LB}') AS parts, regexp_extract_all(text, '[^{WS}]+') AS w FROM documents),
m AS (SELECT *, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '') AS lines,
  CASE WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END AS n_lines FROM l),
f AS (SELECT doc_id, source, text, length(text) AS n_chars, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0) AS mean_word_len,
  len(regexp_extract_all(text, '#|\\.\\.\\.|…')) AS n_symbols,
  CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) END AS alpha_fraction,
  CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(text) END AS alnum_fraction,
  CASE WHEN len(lines) <= 1 THEN 0.0 ELSE (len(lines) - len(list_distinct(lines))) / len(lines) END AS dup_line_fraction,
  length(regexp_replace(text, '{LB}', '', 'g')) / greatest(n_lines, 1) AS mean_line_len, length(array_to_string(w, ' ')) AS n_normal FROM m),
r AS (SELECT *, n_symbols / nullif(n_words, 0) AS symbol_ratio,
  CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN 'code' ELSE 'prose' END AS kind FROM f),
q AS (SELECT *, CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 100000 THEN 'too_long' WHEN n_words = 0 THEN 'no_words' WHEN mean_word_len < 3 THEN 'mean_word_len_low' WHEN mean_word_len > 10 THEN 'mean_word_len_high'
  WHEN n_symbols / n_words > 0.1 THEN 'symbol_ratio_high' WHEN alpha_fraction < 0.6 THEN 'alpha_fraction_low' WHEN dup_line_fraction > 0.3 THEN 'dup_lines_high' END AS prose,
  CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 100000 THEN 'too_long' WHEN mean_line_len > 200 THEN 'code_line_len_high' WHEN alnum_fraction < 0.4 THEN 'code_alnum_low' END AS code FROM r)"""


def prose_reason_hist(spark, d):
    return filters.reason_histogram(filters.with_reason(_docs(spark, d), kind=F.lit("prose")))


def code_reason_hist(spark, d):
    return filters.reason_histogram(filters.with_reason(_docs(spark, d), kind=F.lit("code")))


def kind_dispatch(spark, d):
    return filters.with_reason(_docs(spark, d)).select("doc_id", "kind", "reason")


def filter_stats(spark, d):
    return filters.filter_stats(filters.with_reason(_docs(spark, d)))


def kept_documents(spark, d):
    return filters.keep_documents(_docs(spark, d)).select("doc_id", "kind")


def source_cap_union(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", "source")
    chats = _t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.lit("chat").alias("source"))
    return readers.cap_per_source(docs.unionByName(chats), 40).select("doc_id", "source", F.length("text").alias("n"))


# --- dedup

def exact_dedup(spark, d):
    return dedup.exact_dedup(_docs(spark, d)).select("doc_id", "source")


def exact_dedup_stats(spark, d):
    docs = _docs(spark, d)
    return dedup.dedup_stats(docs, dedup.exact_dedup(docs))


def shingle_counts(spark, d):
    return dedup.document_shingles(_docs(spark, d), K).groupBy("doc_id").agg(F.count("s").alias("n_shingles"))


def optimal_bands(spark, d):
    settings = ((128, 0.8), (64, 0.7), (64, 0.6), (256, 0.5), (100, 0.9))
    return spark.createDataFrame([(n, x, *dedup.optimal_bands(n, x)) for n, x in settings], "num_perm long, threshold double, bands long, rows long")


def _signed(spark, d):
    return dedup.signatures(_docs(spark, d), NUM_PERM, K)


def minhash_signatures(spark, d):
    return _signed(spark, d).select("doc_id", *[F.element_at("sig", i + 1).alias(f"m{i}") for i in range(NUM_PERM)])


def lsh_candidate_pairs(spark, d):
    return dedup.owner_pairs(_signed(spark, d), BANDS, ROWS)


def near_dup_pairs(spark, d):
    signed = materialize(_signed(spark, d))
    return dedup.signature_links(signed, NUM_PERM, THRESHOLD).withColumn("similarity", _r(F.col("similarity")))


def greedy_dedup(spark, d):
    return dedup.minhash_dedup(_docs(spark, d), 128, THRESHOLD, K).select("doc_id")


def greedy_dedup_native(spark, d):
    return dedup.greedy_duplicates(_signed(spark, d), BANDS, ROWS, THRESHOLD)


_SHINGLES = f"""
w AS (SELECT doc_id, regexp_extract_all(text, '[^{WS}]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {K - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) END AS s FROM w)"""
_A, _B = dedup.permutations(NUM_PERM)
_SIGNED = f"""{_SHINGLES},
h AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unnest(s) AS x FROM s)),
g AS (SELECT doc_id, {", ".join(f"min((h::HUGEINT * {a} + {b}) % {dedup.PRIME})::BIGINT AS m{i}" for i, (a, b) in enumerate(zip(_A, _B, strict=True)))} FROM h GROUP BY doc_id),
sig AS (SELECT d.doc_id, {", ".join(f"coalesce(m{i}, {dedup.PRIME}) AS m{i}" for i in range(NUM_PERM))} FROM documents d LEFT JOIN g USING (doc_id)),
arr AS (SELECT doc_id, [{", ".join(f"m{i}" for i in range(NUM_PERM))}] AS sig FROM sig),
band AS (SELECT doc_id, b, sig[b * {ROWS} + 1:b * {ROWS} + {ROWS}] AS key FROM arr, range({BANDS}) r(b)),
own AS (SELECT b, key, min(doc_id) AS owner FROM band GROUP BY b, key),
pairs AS (SELECT DISTINCT owner, doc_id FROM band JOIN own USING (b, key) WHERE owner <> doc_id),
classes AS (SELECT sig, min(doc_id) AS owner FROM arr GROUP BY sig),
sim AS (SELECT x.owner, y.owner AS doc_id, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / {NUM_PERM} AS similarity FROM classes x JOIN classes y ON x.owner < y.owner
UNION ALL SELECT owner, doc_id, 1.0 FROM arr JOIN classes USING (sig) WHERE doc_id <> owner)"""


# --- tokens, packing, sequences

def pretoken_counts(spark, d):
    return tokenizer.pretoken_counts(_docs(spark, d))


def bpe_merges(spark, d):
    """The first 16 merges of all documents' words, with the count that each pair had when its turn came."""
    counts = materialize(tokenizer.pretoken_counts(_docs(spark, d)))
    merges = bpe_training.train(counts, 16, 0)
    drop_table(counts)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank int, left_id int, right_id int, n long")


def bpe_words(spark, d):
    """The dictionary of all documents' words: how often each occurs and how many tokens 16 merges leave of it."""
    counts = materialize(tokenizer.pretoken_counts(_docs(spark, d)))
    words = bpe_training.dictionary(counts, [m[:2] for m in bpe_training.train(counts, 16, 0)], 0)
    return words.select("pretoken", "n", F.size("ids").alias("n_tokens"))


def bpe_encode_stats(spark, d):
    """Ids and lossless decoding of every document with a vocabulary learned on all of them."""
    docs = _docs(spark, d)
    coder = tokenizer.train_tokenizer(docs, 1024, order_col="doc_id")
    out = tokenizer.decode_documents(tokenizer.encode_documents(docs, coder), coder)
    return out.select("doc_id", F.size("ids").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("lossless"))


def _merges_sql(n):
    """n rounds over words spelled as <id><id>...: the most frequent pair (ties to the smaller), then all words without it."""
    words = r"SELECT pretoken, n, list_aggregate(list_transform(range(1, octet_length(encode(pretoken)) + 1), lambda i: '<' || ('0x' || substr(hex(encode(pretoken)), 2 * i - 1, 2))::INT || '>'), 'string_agg', '') AS w FROM pretokens"
    out = [f"w0 AS MATERIALIZED ({words})"]
    for i in range(n):
        out.append(f"p{i} AS MATERIALIZED (SELECT l AS left_id, r AS right_id, sum(n)::BIGINT AS n FROM (SELECT n, unnest(list_zip(t[:-2], t[2:])) AS z, z[1]::INT AS l, z[2]::INT AS r FROM (SELECT n, string_split(w[2:-2], '><') AS t FROM w{i})) GROUP BY ALL ORDER BY n DESC, l, r LIMIT 1)")
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT w{i}.pretoken, w{i}.n, replace(w, '<' || left_id || '><' || right_id || '>', '<{256 + i}>') AS w FROM w{i}, p{i})")
    return ",\n".join(out)


def pack_offsets(spark, d):
    rows = _docs(spark, d).select("doc_id", (F.length("text") + 1).cast("long").alias("n_tokens"), F.when(F.col("doc_id") % 20 == 0, "val").otherwise("train").alias("split"))
    return packing.stream_offsets(rows, "doc_id", "n_tokens", "split")


def pack_manifest(spark, d):
    rows = _docs(spark, d).select("doc_id", (F.length("text") + 1).cast("long").alias("n_tokens"), F.when(F.col("doc_id") % 20 == 0, "val").otherwise("train").alias("split"))
    return packing.manifest(rows, 32_000, 0).drop("files")


def split_hash(spark, d):
    rows = _docs(spark, d).select(F.length("text").cast("long").alias("n_tokens"), packing.split_of(F.col("doc_id"), 0.05, 3).alias("split"))
    return packing.token_totals(rows)


def end_tokens(spark, d):
    """Code points stand for tokens; empty texts go."""
    rows = packing.with_end_token(_t(spark, d, "conversations").select("conv_id", "turn", t.code_points(F.col("text")).alias("ids")), 7, 1 << 21)
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.size("ids").alias("n"), total.alias("total"), F.element_at("ids", -1).alias("last"))


def mixture(spark, d):
    """Two sources one behind the other, the first of them capped."""
    specs = [readers.SourceSpec("docs", f"{d}/documents.parquet", order_key="doc_id", max_docs=77), readers.SourceSpec("pages", f"{d}/pages.parquet", text_key="html", kind="code", order_key="page_id")]
    return readers.read_mixture(spark, specs).select("ord", "idx", "source", "kind", F.length("text").alias("n"))


def token_shards(spark, d):
    rows = packing.shards(pack_offsets(spark, d), 100_000)
    return rows.groupBy("split", "shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))


def token_crops(spark, d):
    stream = _chat_tokens(spark, d)
    starts = stream.agg((F.sum("n") - 1).alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"), F.lit(997).cast("long"))).alias("start"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return packing.crops(stream.select("pos", "ids"), starts, 300).select("start", total("x").alias("sum_x"), total("y").alias("sum_y"), F.element_at("x", 1).alias("first_x"), F.element_at("y", -1).alias("last_y"))


def clean_round_trip(spark, d):
    path = f"{shared_folder(spark)}/clean-{uuid.uuid4().hex}"
    writers.write_clean(_docs(spark, d).select(F.col("doc_id").alias("ord"), "text", "source", "kind"), path)
    return readers.read_clean(spark, path).select("ord", "source", "kind", F.md5("text").alias("text_md5"))


def packed_round_trip(spark, d):
    path = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    rows = _chat_tokens(spark, d).select("pos", "ids", F.when(F.col("pos") % 5 == 0, "val").otherwise("train").alias("split"))
    writers.write_packed(rows, path, "uint32")
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return _union([writers.read_packed(spark, path, s, "uint32").select(F.lit(s).alias("split"), "pos", F.size("ids").alias("n"), total.alias("total")) for s in ("train", "val")])


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


def _chat_tokens(spark, d):
    rows = _t(spark, d, "conversations").where("length(text) > 0").select((F.col("conv_id") * 64 + F.col("turn")).alias("ord"), F.concat(t.code_points(F.col("text")), F.array(F.lit(0))).alias("ids"))
    return packing.stream_offsets(rows.withColumn("n", F.size("ids").cast("long")), "ord", "n")


def pack_blocks(spark, d):
    out = packing.blocks(_chat_tokens(spark, d), 512)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("block", F.size("x").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"), F.element_at("x", 1).alias("first_x"), F.element_at("y", -1).alias("last_y"))


_CHAT_TOKENS = """
c AS (SELECT conv_id * 64 + turn AS ord, list_append(list_transform(string_split(text, ''), lambda x: unicode(x)), 0) AS ids FROM conversations WHERE length(text) > 0),
e AS (SELECT ord, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM c),
s AS (SELECT row_number() OVER (ORDER BY ord, i) - 1 AS pos, id FROM e),
n AS (SELECT pos, id, lead(id) OVER (ORDER BY pos) AS nxt FROM s),
b AS (SELECT pos // 512 AS block, count(*) AS n, count(nxt) AS m, sum(id)::BIGINT AS sum_x, sum(nxt)::BIGINT AS sum_y, arg_min(id, pos) AS first_x, arg_max(nxt, pos) AS last_y FROM n GROUP BY 1)"""


def _example(spark, d):
    ids = t.code_points(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.slice(ids, 1, 20).alias("prompt"), F.slice(ids, F.lit(21), F.greatest(F.size(ids) - 20, F.lit(0))).alias("target"))


def sft_mask(spark, d):
    x, y, usable = sequences.supervised_pair(F.col("prompt"), F.col("target"), 0, 128)
    rows = _example(spark, d).select("conv_id", "turn", x.alias("x"), y.alias("y"), usable.alias("u")).where("u")
    return rows.select("conv_id", "turn", F.size("x").alias("n"), F.size(F.filter("y", lambda v: v == -1)).alias("n_masked"), F.array_join(F.transform("y", lambda v: v.cast("string")), " ").alias("labels"))


def pad_batch(spark, d):
    rows = _example(spark, d).select("conv_id", "turn", F.concat("prompt", "target").alias("ids"))
    longest = rows.groupBy("conv_id").agg(F.max(F.size("ids")).alias("longest"))
    return rows.join(longest, "conv_id").select("conv_id", "turn", F.size(sequences.pad(F.col("ids"), F.col("longest"), 0)).alias("n"), F.size(F.filter(sequences.pad(F.col("ids"), F.col("longest"), 0), lambda v: v == 0)).alias("n_pad"))


def eot_mask(spark, d):
    """A blank stands for the end token, the first ten tokens for the prompt."""
    rows = _t(spark, d, "conversations").select("conv_id", "turn", t.code_points(F.col("text")).alias("ids"))
    plen = F.least(F.lit(10), F.size("ids"))
    rows = rows.select("conv_id", "turn", "ids", plen.alias("p"), sequences.first_end(F.col("ids"), plen, 32).alias("end_index"))
    return rows.select("conv_id", "turn", "end_index", F.aggregate(sequences.completion_mask(F.col("ids"), F.col("p"), F.col("end_index")), F.lit(0), lambda a, v: a + v).alias("n_completion"))


# --- rewards, evaluation, policy

_COMPLETION = "'<think>' || {a} || ' + ' || {b} || '</think>\n<ANSWER> ' || (CASE WHEN {b} = 3 THEN {a} + {b} + 1 ELSE {a} + {b} END) || ' </answer>' || (CASE WHEN {b} = 5 THEN '<answer>none</answer>' ELSE '' END)"


def _completions(spark, d):
    a, b = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    value = F.col("l_orderkey") + b + F.when(b == 3, 1).otherwise(0)
    text = F.concat(F.lit("<think>"), a, F.lit(" + "), b.cast("string"), F.lit("</think>\n<ANSWER> "), value.cast("string"), F.lit(" </answer>"), F.when(b == 5, "<answer>none</answer>").otherwise(""))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("completion"), (F.col("l_orderkey") + b).cast("string").alias("gold"))


def rollout_rewards(spark, d):
    return rollouts.score_rollouts(_completions(spark, d)).select("l_orderkey", "l_linenumber", "answer", "numeric", "format", _r(F.col("reward")).alias("reward"))


_SCORED = f"""
c AS (SELECT l_orderkey, l_linenumber, {_COMPLETION.format(a="l_orderkey", b="l_linenumber")} AS t, l_orderkey + l_linenumber AS gold FROM lineitem),
x AS (SELECT *, trim(regexp_extract_all(t, '(?is)<answer>(.*?)</answer>', 1)[-1]) AS answer FROM c),
r AS (SELECT *, CASE WHEN abs(TRY_CAST(answer AS DOUBLE) - gold) <= 1e-6 THEN 1.0 ELSE 0.0 END::DOUBLE AS numeric, 1.0::DOUBLE AS format FROM x)"""


def eval_accuracy(spark, d):
    out = rollouts.evaluation(rollouts.score_rollouts(_completions(spark, d)))
    return out.select("n", _r(F.col("accuracy")).alias("accuracy"), _r(F.col("format_rate")).alias("format_rate"))


def batch_rewards(spark, d):
    out = rollouts.batch_means(rollouts.score_rollouts(_completions(spark, d)).withColumn("step", F.col("l_orderkey") % 50), ["step"])
    return out.select("step", _r(F.col("mean_reward")).alias("mean_reward"), _r(F.col("accuracy")).alias("accuracy"))


def code_extract(spark, d):
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("see\n```python\nprint("), key, F.lit(")\n```\nand\n```\nreturn "), key, F.lit("\n```"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("<answer> f("), key, F.lit(") </answer>"))).otherwise(F.concat(F.lit(" x = "), key, F.lit("\n")))
    return _t(spark, d, "orders").select("o_orderkey", rewards.extract_code(text).alias("code"))


def gsm_split(spark, d):
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(" no mark "), key)).otherwise(F.concat(F.lit("think "), key, F.lit(" \n#### -1,"), key))
    return _t(spark, d, "orders").select("o_orderkey", rewards.reasoning(text).alias("thought"), rewards.final_answer(text).alias("gold"))


def _rewards_of_events(spark, d):
    return _t(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.col("value").alias("reward"))


def group_advantage(spark, d):
    out = rollouts.group_advantage(_rewards_of_events(spark, d), ["user_id", "day"])
    return out.select("event_id", _r(F.col("mean"), 4).alias("mean"), _r(F.col("advantage"), 3).alias("advantage"))


def masked_mean(spark, d):
    mask = (F.col("event_id") % 3 == 0).cast("double")
    return _t(spark, d, "events").groupBy("event_type").agg(_r(rollouts.masked_mean(F.col("value"), mask), 4).alias("masked_mean"))


def ppo_terms(spark, d):
    ratio, adv, delta = F.col("value") / 50.0, F.col("value") / 25.0 - 1.0, F.col("value") / 100.0 - 0.5
    return _t(spark, d, "events").select("event_id", _r(training.clipped_policy_loss(ratio, adv)).alias("policy_loss"), _r(training.kl_estimate(delta, F.lit(0.0))).alias("kl"))


def arithmetic_tasks(spark, d):
    return tasks.arithmetic_examples(spark, 5000, 3, 99, "+-*")


def _draw_sql(i, seed, stream, n):
    x = f"((((({i}) * 48271 + {seed * 7919 + stream * 104_729 + 12_345}) % 2147483647) * 69621 + {stream + 1}) % 2147483647)"
    return f"((({x} % 46337) * ({x} // 46337) + {x}) % 2147483647 // 7) % {n}"


def held_out_tasks(spark, d):
    return tasks.held_out(tasks.preset(spark, "arithmetic", 2000, 5), tasks.preset(spark, "arithmetic", 8000, 0)).select("id", "question", "gold")


def _tasks_sql(n, seed, largest, ops):
    return f"""(SELECT id, CASE WHEN op = '-' AND a < b THEN b ELSE a END AS a, CASE WHEN op = '-' AND a < b THEN a ELSE b END AS b, op FROM (SELECT id, {_draw_sql("id", seed, 1, largest - 1)} + 2 AS a, {_draw_sql("id", seed, 2, largest - 1)} + 2 AS b, substr('{ops}', ({_draw_sql("id", seed, 3, len(ops))})::INT + 1, 1) AS op FROM range({n}) r(id)))"""


def _spaced_sql(x):
    return f"array_to_string(string_split(({x})::VARCHAR, ''), ' ')"


_VALUE = "(CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b ELSE a * b END)"


def lr_schedule(spark, d):
    return spark.range(4000).select(F.col("id").alias("step"), _r(training.learning_rate(F.col("id"), 200, 3200, 6e-4, 6e-5), 9).alias("lr"))


def throughput(spark, d):
    step = F.col("id") + 1
    seconds, tokens = step / 7.0, F.lit(262_144.0)
    return spark.range(500).select(step.alias("step"), _r(training.tokens_per_second(tokens, seconds), 3).alias("tok_s"), _r(training.model_flops_utilisation(F.lit(118e6), tokens, seconds), 9).alias("mfu"), training.parameter_estimate(F.lit(32_000).cast("long"), step, F.lit(768).cast("long")).alias("params"))


def log_lines(spark, d):
    lines = _t(spark, d, "events").select(F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" | loss "), (F.col("event_id") / 8.0).cast("decimal(20,3)").cast("string"), F.lit(" | lr 1e-4")).alias("value"))
    return logs.parse_log(lines, "loss")


def last_user_message(spark, d):
    return rollouts.last_user_message(_t(spark, d, "conversations"))


def top_k_events(spark, d):
    return rollouts.top_k(_t(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value", 50)


def softmax_events(spark, d):
    rows = rollouts.softmax_shares(_t(spark, d, "events").select("user_id", "event_id", F.col("value").alias("score")), ["user_id"], "score", 25.0)
    return rows.select("user_id", "event_id", _r(F.col("share")).alias("share"))


def supervised_pairs(spark, d):
    return tasks.supervised(tasks.arithmetic_examples(spark, 3000, 3, 99, "+-*"))


def reinforcement_prompts(spark, d):
    return tasks.reinforcement(tasks.preset(spark, "arithmetic_hard", 3000, 5))


def solved_questions(spark, d):
    key = F.col("o_orderkey").cast("string")
    answer = F.concat(F.lit("first "), key, F.lit(", then more\n#### "), key, F.lit(",000"))
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("How many "), key, F.lit("?")).alias("question"), answer.alias("answer"))
    return tasks.solved_questions(rows, 500)


def batch_sizes(spark, d):
    """Batches of a seeded shuffle: every row in one, all full but the last."""
    rows = tasks.batches(_t(spark, d, "events").select(F.col("event_id").alias("id")), 64, 5, 1)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


SHARES = {"en": 5, "fr": 3, "de": 2, "es": 1}


def token_shares(spark, d):
    """Languages as sources, cut to their shares of tokens; code points and an end token stand for tokens."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", (F.length("text") + 1).cast("long").alias("n_tokens"))
    return shares.token_shares(docs, SHARES, "n_tokens", "lang", "doc_id", seed=11)


EPOCH_SEED, EPOCH, EPOCH_BATCH = 5, 2, 256


def seekable_epoch(spark, d):
    """The place and batch of every document in one epoch, by its row number alone."""
    rows = packing.stream_offsets(_t(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("one")), "doc_id", "one")
    return epochs.epoch_places(rows, rows.count(), EPOCH_BATCH, EPOCH_SEED, EPOCH, "pos").select("doc_id", "place", "batch")


def _rounds_sql(rows):
    """All rounds over rows of i and x; the sides a and b are in z."""
    def mix(v, k1, k2):
        v = f"(({v} + {k1}) % {epochs.PRIME})"
        v = f"(({v} * {v} + {k2}) % {epochs.PRIME})"
        return f"(({v} * {v} + {k1}) % {epochs.PRIME})"

    out = f"SELECT i, x // b AS l, x % b AS r FROM ({rows}), z"
    for i, keys in enumerate(epochs.round_keys(EPOCH_SEED, EPOCH)):
        out = f"SELECT i, (l + {mix('r', *keys)}) % a AS l, r FROM ({out}), z" if i % 2 == 0 else f"SELECT i, l, (r + {mix('l', *keys)}) % b AS r FROM ({out}), z"
    return f"SELECT i, l * b + r AS x FROM ({out}), z"


def rollout_rows(spark, d):
    """Texts as rollouts: padded to the longest of the conversation, shifted by one; the first ten tokens are prompt."""
    rows = _t(spark, d, "conversations").select("conv_id", "turn", t.code_points(F.col("text")).alias("ids"))
    rows = rows.withColumn("mask", sequences.completion_mask(F.col("ids"), F.lit(10), F.size("ids")))
    longest = rows.groupBy("conv_id").agg(F.max(F.size("ids")).alias("longest"))
    x, y, m = sequences.rollout_row(F.col("ids"), F.col("mask"), F.col("longest"), 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.join(longest, "conv_id").select("conv_id", "turn", F.size(x).alias("n"), total(x).alias("sum_x"), total(y).alias("sum_y"), total(m).alias("n_completion"))


def evaluation_loss(spark, d):
    rows = _t(spark, d, "events").select("event_type", "event_id", (F.col("value") / 10).alias("loss"))
    out = rollouts.evaluation_loss(rows, ["event_type"], "event_id")
    return out.select("event_type", _r(F.col("val_loss")).alias("val_loss"), "n_batches")


def token_log_prob(spark, d):
    v = F.col("value")
    rows = _t(spark, d, "events").select("event_id", F.array(v / 10, v / 20, F.lit(1.5), -v).alias("logits"), (F.col("event_id") % 4).cast("int").alias("i"))
    return rows.select("event_id", (_r(training.token_log_prob(F.col("logits"), F.col("i"))) + F.lit(0.0)).alias("log_prob"))


def code_pass_rate(spark, d):
    """Fixed, harmless programs: one group of tests passes, one fails; a program without tests gets 0."""
    key = F.col("r_regionkey").cast("string")
    code = F.concat(F.lit("see\n```python\ndef f(x):\n    return x + "), key, F.lit("\n```"))
    tests = F.when(F.col("r_regionkey") == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("assert f(1) == 1 + "), key), F.concat(F.lit("assert f(1) == 2 + "), key)))
    rows = _t(spark, d, "region").select(F.col("r_regionkey").alias("id"), code.alias("completion"), tests.alias("tests"))
    return code_exec.code_rewards(rows, allow_untrusted=True)


def unicode_numbers(spark, d):
    """Numbers in ASCII, Arabic-Indic and full-width digits."""
    key = F.col("o_orderkey").cast("string")
    shown = F.when(F.col("o_orderkey") % 3 == 0, key).when(F.col("o_orderkey") % 3 == 1, F.translate(key, "0123456789", "".join(chr(0x660 + i) for i in range(10)))).otherwise(F.translate(key, "0123456789", "".join(chr(0xFF10 + i) for i in range(10))))
    return _t(spark, d, "orders").select("o_orderkey", rewards.to_number(F.concat(F.lit("about "), shown, F.lit(" in all"))).alias("number"))


_FUNCTIONS = (quality_features, prose_reason_hist, code_reason_hist, kind_dispatch, filter_stats, kept_documents, source_cap_union, exact_dedup, exact_dedup_stats, shingle_counts, optimal_bands, minhash_signatures, lsh_candidate_pairs, near_dup_pairs, greedy_dedup, greedy_dedup_native, pretoken_counts, bpe_merges, bpe_words, bpe_encode_stats, pack_offsets, pack_manifest, split_hash, pack_blocks, sft_mask, pad_batch, eot_mask, rollout_rewards, eval_accuracy, batch_rewards, code_extract, gsm_split, group_advantage, masked_mean, ppo_terms, arithmetic_tasks, held_out_tasks, lr_schedule, throughput, log_lines, last_user_message, top_k_events, softmax_events, end_tokens, mixture, token_shards, token_crops, clean_round_trip, packed_round_trip, supervised_pairs, reinforcement_prompts, solved_questions, batch_sizes, token_shares, seekable_epoch, rollout_rows, evaluation_loss, token_log_prob, code_pass_rate, unicode_numbers)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_NORMAL = f"SELECT *, array_to_string(regexp_extract_all(text, '[^{WS}]+'), ' ') AS p FROM documents"
# White space before a word parts at its last character; a mark stands there, as this engine's patterns look at nothing ahead.
_PRETOKENS = r"SELECT replace(pretoken, chr(1), '') AS pretoken, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '(\s)(\S)', chr(1) || '\1\2', 'g'), '\x01?''(?:s|t|re|ve|m|ll|d)|\x01? ?\p{L}+|\x01? ?\p{N}+|\x01? ?[^\s\p{L}\p{N}\x01]+|\x01?\s+')) AS pretoken FROM documents) GROUP BY 1"
ORACLE_SQL = {
    "quality_features": f"{_FEATURES} SELECT doc_id, n_chars, n_words, round(mean_word_len, 6) AS mean_word_len, n_symbols, round(symbol_ratio, 6) AS symbol_ratio, round(alpha_fraction, 6) AS alpha_fraction, round(alnum_fraction, 6) AS alnum_fraction, round(dup_line_fraction, 6) AS dup_line_fraction, round(mean_line_len, 6) AS mean_line_len, n_normal FROM q",
    "prose_reason_hist": f"{_FEATURES} SELECT prose AS reason, count(*) AS n FROM q WHERE prose IS NOT NULL GROUP BY prose",
    "code_reason_hist": f"{_FEATURES} SELECT code AS reason, count(*) AS n FROM q WHERE code IS NOT NULL GROUP BY code",
    "kind_dispatch": f"{_FEATURES} SELECT doc_id, kind, CASE kind WHEN 'code' THEN code ELSE prose END AS reason FROM q",
    "filter_stats": f"{_FEATURES}, z AS (SELECT CASE kind WHEN 'code' THEN code ELSE prose END AS reason FROM q) SELECT count(*) AS documents_in, count(*) FILTER (reason IS NULL) AS kept, count(reason) AS rejected FROM z",
    "kept_documents": f"{_FEATURES} SELECT doc_id, kind FROM q WHERE CASE kind WHEN 'code' THEN code ELSE prose END IS NULL",
    "source_cap_union": "SELECT doc_id, source, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM (SELECT doc_id, text, source FROM documents UNION ALL SELECT conv_id * 1000 + turn, text, 'chat' FROM conversations) WHERE text <> '') WHERE r <= 40",
    "exact_dedup": f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY doc_id) AS r FROM ({_NORMAL})) WHERE r = 1",
    "exact_dedup_stats": f"SELECT count(*) AS seen, count(*) - count(DISTINCT p) AS duplicates_removed, count(DISTINCT p) AS kept FROM ({_NORMAL})",
    "shingle_counts": f"WITH {_SHINGLES} SELECT doc_id, len(s) AS n_shingles FROM s",
    "optimal_bands": "SELECT num_perm, threshold, arg_min(b, (round(abs(threshold - pow(1.0 / b, b / num_perm)), 12), b)) AS bands, num_perm // bands AS rows FROM (VALUES (128, 0.8::DOUBLE), (64, 0.7), (64, 0.6), (256, 0.5), (100, 0.9)) v(num_perm, threshold), range(1, 257) r(b) WHERE b <= num_perm AND num_perm % b = 0 GROUP BY num_perm, threshold",
    "minhash_signatures": f"WITH {_SIGNED} SELECT * FROM sig",
    "lsh_candidate_pairs": f"WITH {_SIGNED} SELECT owner, doc_id FROM pairs",
    "near_dup_pairs": f"WITH {_SIGNED} SELECT owner, doc_id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= {THRESHOLD}",
    "pretoken_counts": _PRETOKENS,
    "bpe_words": f"WITH pretokens AS ({_PRETOKENS}), {_merges_sql(16)} SELECT pretoken, n, len(w) - len(replace(w, '<', '')) AS n_tokens FROM w16",
    "bpe_merges": f"WITH pretokens AS ({_PRETOKENS}), {_merges_sql(16)} " + " UNION ALL ".join(f"SELECT {i}::INT AS rank, left_id, right_id, n FROM p{i}" for i in range(16)),
    "pack_offsets": "SELECT doc_id, n_tokens, split, coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM (SELECT doc_id, length(text) + 1 AS n_tokens, CASE WHEN doc_id % 20 = 0 THEN 'val' ELSE 'train' END AS split FROM documents)",
    "pack_manifest": "SELECT 'uint16' AS dtype, 0 AS eot_id, 32000 AS vocab_size, count(*) AS n_docs, coalesce(sum(length(text) + 1) FILTER (doc_id % 20 <> 0), 0)::BIGINT AS train_tokens, coalesce(sum(length(text) + 1) FILTER (doc_id % 20 = 0), 0)::BIGINT AS val_tokens FROM documents",
    "split_hash": "SELECT CASE WHEN ('0x' || substr(md5('3:' || doc_id), 1, 8))::BIGINT % 1000000 < 50000 THEN 'val' ELSE 'train' END AS split, count(*) AS n_docs, sum(length(text))::BIGINT AS tokens FROM documents GROUP BY 1",
    "pack_blocks": f"WITH {_CHAT_TOKENS} SELECT block, n, sum_x, sum_y, first_x, last_y FROM b WHERE n = 512 AND m = 512",
    "sft_mask": "WITH c AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda x: unicode(x)) AS ids FROM conversations), f AS (SELECT conv_id, turn, len(ids[:20]) AS p, list_append(ids, 0)[:128] AS full_ FROM c), y AS (SELECT *, list_transform(range(2, len(full_) + 1), lambda i: CASE WHEN i <= p THEN -1 ELSE full_[i] END) AS y FROM f WHERE len(full_) >= 2 AND p < len(full_)) SELECT conv_id, turn, len(y) AS n, len(list_filter(y, lambda v: v = -1)) AS n_masked, array_to_string(y, ' ') AS labels FROM y",
    "pad_batch": "WITH c AS (SELECT conv_id, turn, length(text) AS k FROM conversations), m AS (SELECT *, max(k) OVER (PARTITION BY conv_id) AS longest FROM c) SELECT conv_id, turn, longest AS n, longest - k AS n_pad FROM m",
    "eot_mask": "WITH c AS (SELECT conv_id, turn, length(text) AS n, least(10, length(text)) AS p, instr(substr(text, least(10, length(text)) + 1), ' ') AS hit FROM conversations) SELECT conv_id, turn, CASE WHEN hit > 0 THEN p + hit ELSE n END AS end_index, CASE WHEN hit > 0 THEN hit ELSE n - p END AS n_completion FROM c",
    "rollout_rewards": f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, answer, numeric, format, round(numeric + 0.1 * format, 6) AS reward FROM r",
    "eval_accuracy": f"WITH {_SCORED} SELECT count(*) AS n, round(avg(numeric) * 100, 6) AS accuracy, round(avg(format) * 100, 6) AS format_rate FROM r",
    "batch_rewards": f"WITH {_SCORED} SELECT l_orderkey % 50 AS step, round(avg(numeric + 0.1 * format), 6) AS mean_reward, round(avg(numeric), 6) AS accuracy FROM r GROUP BY 1",
    "code_extract": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'return ' || o_orderkey WHEN 1 THEN 'f(' || o_orderkey || ')' ELSE 'x = ' || o_orderkey END AS code FROM orders",
    "gsm_split": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'no mark ' || o_orderkey ELSE 'think ' || o_orderkey END AS thought, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '-1' || o_orderkey END AS gold FROM orders",
    "group_advantage": "WITH g AS (SELECT event_id, value, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE)) SELECT event_id, round(mean, 4) AS mean, round((value - mean) / (std + 1e-4), 3) AS advantage FROM g",
    "masked_mean": "SELECT event_type, round(sum(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END) / greatest(count(*) FILTER (event_id % 3 = 0), 1.0), 4) AS masked_mean FROM events GROUP BY 1",
    "ppo_terms": "SELECT event_id, round(-least(value / 50 * (value / 25 - 1), least(greatest(value / 50, 0.8), 1.2) * (value / 25 - 1)), 6) AS policy_loss, round(exp(value / 100 - 0.5) - (value / 100 - 0.5) - 1, 6) AS kl FROM events",
    "arithmetic_tasks": f"SELECT id, 'What is ' || a || ' ' || op || ' ' || b || '?' AS question, {_spaced_sql('a')} || ' ' || op || ' ' || {_spaced_sql('b')} || ' = ' || {_spaced_sql(_VALUE)} AS thought, {_spaced_sql(_VALUE)} AS answer, {_VALUE}::VARCHAR AS gold FROM {_tasks_sql(5000, 3, 99, '+-*')}",
    "held_out_tasks": f"SELECT id, 'What is ' || a || ' ' || op || ' ' || b || '?' AS question, (a + b)::VARCHAR AS gold FROM {_tasks_sql(2000, 5, 99, '+')} WHERE (a, b) NOT IN (SELECT (a, b) FROM {_tasks_sql(8000, 0, 99, '+')})",
    "lr_schedule": "SELECT range AS step, round(CASE WHEN range < 200 THEN 6e-4 * (range + 1) / 200 WHEN range >= 3200 THEN 6e-5 ELSE 6e-5 + 0.5 * (6e-4 - 6e-5) * (1 + cos(pi() * (range - 200) / 3000)) END, 9) AS lr FROM range(4000)",
    "throughput": "SELECT range + 1 AS step, round(262144.0::DOUBLE / ((range + 1) / 7), 3) AS tok_s, round(6.0::DOUBLE * 118e6 * 262144 / ((range + 1) / 7 * 312e12), 9) AS mfu, 32000 * 768 + (range + 1) * 12 * 768 * 768 AS params FROM range(500)",
    "log_lines": "SELECT event_id AS step, round(event_id / 8, 3) AS loss FROM events",
    "last_user_message": "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS message FROM conversations GROUP BY conv_id",
    "top_k_events": "SELECT event_type, event_id, value FROM (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS r FROM events) WHERE r <= 50",
    "softmax_events": "SELECT user_id, event_id, round(exp((value - max(value) OVER w) / 25) / sum(exp(value / 25)) OVER w * exp(max(value) OVER w / 25), 6) AS share FROM events WINDOW w AS (PARTITION BY user_id)",
    "end_tokens": "SELECT conv_id, turn, length(text) + 1 AS n, (list_sum(list_transform(string_split(text, ''), lambda x: unicode(x))) + 7)::BIGINT AS total, 7 AS last FROM conversations WHERE length(text) > 0",
    "mixture": "WITH a AS (SELECT row_number() OVER (ORDER BY doc_id, text) - 1 AS idx, 'docs' AS source, 'prose' AS kind, length(text) AS n FROM documents WHERE text <> ''), b AS (SELECT row_number() OVER (ORDER BY page_id, html) - 1 AS idx, 'pages' AS source, 'code' AS kind, length(html) AS n FROM pages WHERE html <> '') SELECT idx AS ord, * FROM a WHERE idx < 77 UNION ALL SELECT idx + (SELECT count(*) FROM a WHERE idx < 77), * FROM b",
    "token_shards": "WITH r AS (SELECT length(text) + 1 AS n, CASE WHEN doc_id % 20 = 0 THEN 'val' ELSE 'train' END AS split, doc_id FROM documents), p AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY doc_id) - n AS pos FROM r) SELECT split, (pos // 100000)::BIGINT AS shard, count(*) AS n_docs, sum(n)::BIGINT AS tokens FROM p GROUP BY 1, 2",
    "token_crops": f"WITH {_CHAT_TOKENS.split('b AS (')[0].rstrip().rstrip(',')}, q AS (SELECT pos, pos AS start FROM n WHERE pos % 997 = 0) SELECT q.start, sum(n.id)::BIGINT AS sum_x, sum(n.nxt)::BIGINT AS sum_y, arg_min(n.id, n.pos) AS first_x, arg_max(n.nxt, n.pos) AS last_y FROM q JOIN n ON n.pos BETWEEN q.start AND q.start + 299 GROUP BY q.start HAVING count(n.nxt) = 300",
    "clean_round_trip": "SELECT doc_id AS ord, source, CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN 'code' ELSE 'prose' END AS kind, md5(text) AS text_md5 FROM documents",
    "packed_round_trip": "WITH c AS (SELECT conv_id * 64 + turn AS ord, length(text) + 1 AS n, list_sum(list_transform(string_split(text, ''), lambda x: unicode(x)))::BIGINT AS total FROM conversations WHERE length(text) > 0), p AS (SELECT *, (sum(n) OVER (ORDER BY ord) - n)::BIGINT AS pos FROM c) SELECT CASE WHEN pos % 5 = 0 THEN 'val' ELSE 'train' END AS split, pos, n, total FROM p",
    "supervised_pairs": f"SELECT id, 'Solve the problem. Think first, then give the answer.' || chr(10) || 'Question: What is ' || a || ' ' || op || ' ' || b || '?' || chr(10) AS prompt, '<think>' || {_spaced_sql('a')} || ' ' || op || ' ' || {_spaced_sql('b')} || ' = ' || {_spaced_sql(_VALUE)} || '</think>' || chr(10) || '<answer>' || {_spaced_sql(_VALUE)} || '</answer>' AS target FROM {_tasks_sql(3000, 3, 99, '+-*')}",
    "reinforcement_prompts": f"SELECT id, 'Solve the problem. Think first, then give the answer.' || chr(10) || 'Question: What is ' || a || ' ' || op || ' ' || b || '?' || chr(10) AS prompt, {_VALUE}::VARCHAR AS gold FROM {_tasks_sql(3000, 5, 999, '+-')}",
    "solved_questions": "SELECT o_orderkey AS id, 'How many ' || o_orderkey || '?' AS question, 'first ' || o_orderkey || ', then more' AS thought, o_orderkey || '000' AS gold FROM orders ORDER BY o_orderkey LIMIT 500",
    "batch_sizes": "WITH e AS (SELECT count(*) AS c FROM events) SELECT range::BIGINT AS batch, least(64, c - 64 * range)::BIGINT AS n, least(64, c - 64 * range)::BIGINT AS n_ids FROM e, range((SELECT (count(*) + 63) // 64 FROM events))",
    "token_shares": "WITH t AS (SELECT doc_id, lang, length(text) + 1 AS n_tokens, ('0x' || substr(md5('11:' || doc_id), 1, 15))::BIGINT AS k FROM documents), w(lang, w) AS (VALUES " + ", ".join(f"('{s}', {w})" for s, w in SHARES.items()) + "), s AS (SELECT lang, w, sum(n_tokens)::BIGINT AS total FROM t JOIN w USING (lang) GROUP BY lang, w), m AS (SELECT arg_min(total, total / w) AS total, arg_min(w, total / w) AS part FROM s), c AS (SELECT doc_id, lang, n_tokens, sum(n_tokens) OVER (PARTITION BY lang ORDER BY k) AS upto FROM t) SELECT doc_id, lang, n_tokens FROM c JOIN w USING (lang), m WHERE upto <= w * m.total // m.part",
    "seekable_epoch": f"WITH RECURSIVE e AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x FROM documents), n AS (SELECT count(*) AS n FROM e), z AS (SELECT n, ceil(sqrt(n))::BIGINT AS a, ((n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT)::BIGINT AS b FROM n), w AS ({_rounds_sql('SELECT range AS i, range AS x FROM range((SELECT n FROM n))')} UNION ALL {_rounds_sql('SELECT w.i, w.x FROM w, z WHERE w.x >= z.n')}) SELECT doc_id, i AS place, i // {EPOCH_BATCH} AS batch FROM w JOIN e USING (x)",
    "rollout_rows": "WITH c AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda x: unicode(x)) AS ids FROM conversations), l AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS longest FROM c) SELECT conv_id, turn, greatest(longest - 1, 0) AS n, (coalesce(list_sum(ids), 0) - CASE WHEN len(ids) = longest THEN coalesce(ids[-1], 0) ELSE 0 END)::BIGINT AS sum_x, (coalesce(list_sum(ids), 0) - coalesce(ids[1], 0))::BIGINT AS sum_y, greatest(len(ids) - 10, 0)::BIGINT AS n_completion FROM l",
    "evaluation_loss": "SELECT event_type, round(avg(value / 10), 6) AS val_loss, count(*) AS n_batches FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 20 GROUP BY event_type",
    "token_log_prob": "WITH l AS (SELECT event_id, [value / 10, value / 20, 1.5::DOUBLE, -value] AS x FROM events) SELECT event_id, round(x[event_id % 4 + 1] - list_max(x) - ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))), 6) + 0.0::DOUBLE AS log_prob FROM l",
    "code_pass_rate": "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 4 THEN 0.0 ELSE 0.5 END::DOUBLE AS pass_rate FROM region",
    "unicode_numbers": "SELECT o_orderkey, o_orderkey::DOUBLE AS number FROM orders",
}

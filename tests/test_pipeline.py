"""Tokenizer, packing, sources, streaming, and the whole build."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import packing, tokenizer
from sparkloom.plans import pipeline
from sparkloom.sources import readers, writers
from sparkloom.streaming import curation


def test_sample_build(spark, tmp_path):
    report = pipeline.run(spark, dict(pipeline.SAMPLE_CONFIG), str(tmp_path), sample=True)
    stats, manifest = report["stats"], report["manifest"]
    assert stats["filter"]["kept"] + stats["filter"]["rejected"] == stats["documents_in"] == 9
    assert sum(stats["filter"]["by_reason"].values()) == stats["filter"]["rejected"]
    assert stats["dedup"]["duplicates_removed"] >= 2 and manifest["train_tokens"] > 0 and manifest["val_tokens"] == 0
    out = io.BytesIO()
    writers.export_binary(spark, f"{tmp_path}/packed", "train", out)
    ids = np.frombuffer(out.getvalue(), dtype=manifest["dtype"])
    assert len(ids) == manifest["train_tokens"] and ids[-1] == manifest["eot_id"] == 0
    assert (ids == 0).sum() == stats["dedup"]["kept"]
    assert readers.read_clean(spark, f"{tmp_path}/clean").count() == stats["dedup"]["kept"]


def test_tokenizer_is_lossless_and_compresses(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coder = tokenizer.train_tokenizer(docs, 600, ("<|endoftext|>", "<|pad|>"), 50, "doc_id")
    assert coder.vocab_size == 600 and coder.token_id("<|pad|>") == 1
    with pytest.raises(KeyError):
        coder.token_id("not a token at all")
    for text in ["", "héllo wörld\n\t…", "a" * 300, "😀 1234 <|endoftext|>"]:
        assert coder.decode(coder.encode(text)) == text
    coder.save(f"{tmp_path}/t.json")
    again = tokenizer.Tokenizer.load(f"{tmp_path}/t.json")
    text = docs.first().text
    assert again.encode(text) == coder.encode(text) and len(coder.encode(text)) < 0.7 * len(text.encode())


def test_merges_break_ties_by_the_smaller_pair():
    assert tokenizer.train_merges({"abab": 2, "cd": 4}, 2, 0) == [(97, 98), (99, 100)]


def test_blocks_and_offsets(spark):
    rows = spark.createDataFrame([(i * 100_000, list(range(i * 10, i * 10 + i % 5))) for i in range(40)], "ord long, ids array<int>").withColumn("n", F.size("ids").cast("long"))
    placed = packing.stream_offsets(rows, "ord", "n")
    stream = [x for r in placed.orderBy("ord").collect() for x in r.ids]
    got = {r.block: (r.x, r.y) for r in packing.blocks(placed, 7).collect()}
    assert got == {b: (stream[7 * b : 7 * b + 7], stream[7 * b + 1 : 7 * b + 8]) for b in range((len(stream) - 1) // 7)}


def test_ids_beyond_the_vocabulary_fail(spark):
    rows = spark.createDataFrame([([1, 2],), ([],)], "ids array<int>")
    assert [r.ids for r in packing.with_end_token(rows, 0, 3).collect()] == [[1, 2, 0]]
    with pytest.raises(Exception, match="beyond the vocabulary"):
        packing.with_end_token(rows, 0, 2).collect()
    assert packing.token_dtype(65_536) == "uint16" and packing.token_dtype(65_537) == "uint32"


def test_sources(spark, tmp_path):
    spark.createDataFrame([(3, "c"), (1, "a"), (2, None), (4, ""), (5, "e")], "k long, body string").write.parquet(f"{tmp_path}/a")
    (tmp_path / "b.txt").write_text("x\n\ny\nz\n")
    specs = [readers.SourceSpec("a", f"{tmp_path}/a", text_key="body", order_key="k", max_docs=2), readers.SourceSpec.from_dict({"name": "b", "path": f"{tmp_path}/b.txt", "format": "text", "kind": "code", "max_docs": 0})]
    got = [(r.text, r.source, r.kind) for r in readers.read_mixture(spark, specs).orderBy("ord").collect()]
    assert got == [("a", "a", "prose"), ("c", "a", "prose"), ("x", "b", "code"), ("y", "b", "code"), ("z", "b", "code")]
    docs = spark.createDataFrame([(i, "t" * 10, f"s{i % 2}") for i in range(400)], "ord long, text string, source string")
    kept = {r["source"]: r["count"] for r in readers.weighted_mixture(docs, {"s0": 3.0, "s1": 1.0}).groupBy("source").count().collect()}
    assert kept["s0"] == 200 and 30 <= kept["s1"] <= 110


def test_json_lines(spark, tmp_path):
    import zstandard

    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.compress(b'{"text":"a","source":"s","kind":"code"}\n{"text":"b","source":"s"}\n{"text":"cut'))
    assert [(r.text, r.kind) for r in readers.read_json_lines_zstd(spark, f"{tmp_path}/x.jsonl.zst").collect()] == [("a", "code"), ("b", "prose")]
    writers.write_json_lines(readers.sample_documents(spark), f"{tmp_path}/j")
    assert readers.read_json_lines(spark, f"{tmp_path}/j").count() == 9


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "same  text" if i % 2 else f"text {i}") for i in range(10)]
    spark.createDataFrame(rows, "ord long, at string, text string").select("ord", F.to_timestamp("at").alias("at"), "text").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ord long, at timestamp, text string").parquet(f"{tmp_path}/in")
    query = curation.exact_dedup_stream(stream, "at", "1 hour").writeStream.format("memory").queryName("deduped").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("deduped").count() == 6

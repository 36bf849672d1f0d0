"""Every key of the public configuration changes the build; keys that don't are warned of."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dedup, filters, tokenizer
from sparkloom.plans import pipeline
from sparkloom.sources import readers

PUBLIC = {
    "sources": [{"name": "web", "hf_path": "PLACE/web", "split": "train", "text_key": "body", "weight": 0.6, "max_docs": 30}, {"name": "code", "hf_path": "PLACE/code", "hf_config": None, "text_key": "text", "kind": "code", "weight": 0.4, "max_docs": 0}],
    "filters": {"min_chars": 20, "max_chars": 100000, "min_mean_word_len": 1.0, "max_mean_word_len": 20.0, "max_symbol_to_word_ratio": 0.5, "min_alpha_fraction": 0.3, "max_dup_line_fraction": 0.9, "code_max_mean_line_len": 2000, "code_min_alnum_fraction": 0.1},
    "dedup": {"enabled": True, "method": "minhash", "num_perm": 64, "jaccard_threshold": 0.8, "shingle_size": 3},
    "tokenizer": {"train": True, "vocab_size": 270, "model": "bpe", "sample_docs": 20, "special_tokens": ["<|endoftext|>", "<|pad|>"], "out": None},
    "pack": {"dtype": "uint16", "shard_size_tokens": 500, "eot_token": "<|pad|>", "val_fraction": 0.3},
}


@pytest.fixture
def sources(spark, tmp_path):
    texts = [(f"the {i} river runs past {i * 7} mills and {i % 4} old bridges before it meets the sea",) for i in range(40)]
    spark.createDataFrame(texts, "body string").coalesce(1).write.parquet(f"{tmp_path}/web/train-0")
    spark.createDataFrame([(f"def f_{i}(x):\n    return x + {i}\n",) for i in range(12)], "text string").coalesce(1).write.parquet(f"{tmp_path}/code")
    return json.loads(json.dumps(PUBLIC).replace("PLACE", str(tmp_path)))


def test_public_configuration_builds(spark, sources, tmp_path):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        report = pipeline.run(spark, sources, f"{tmp_path}/out")
    manifest = json.loads(readers.read_text_file(spark, f"{tmp_path}/out/manifest.json"))
    assert manifest == report["manifest"] == json.loads(readers.read_text_file(spark, f"{tmp_path}/out/report.json"))["manifest"]
    assert report["stats"]["documents_in"] == 42 and manifest["vocab_size"] == 270 and manifest["eot_id"] == 1 and manifest["dtype"] == "uint16"
    assert manifest["val_tokens"] > 0
    coder = tokenizer.Tokenizer.from_json(readers.read_text_file(spark, f"{tmp_path}/out/tokenizer.json"))
    assert coder.special == ["<|endoftext|>", "<|pad|>"]
    packed = spark.read.parquet(f"{tmp_path}/out/packed")
    assert packed.select("split", "shard").distinct().count() > 2
    # A tokenizer that is there already is read from the same key.
    again = pipeline.run(spark, sources | {"tokenizer": {"train": False, "out": f"{tmp_path}/out/tokenizer.json"}, "pack": {"dtype": "uint32", "val_fraction": 0.0}}, f"{tmp_path}/again")
    assert again["manifest"]["dtype"] == "uint32" and again["manifest"]["eot_id"] == 0 and again["manifest"]["val_tokens"] == 0


def test_unknown_keys_are_warned_of(spark, tmp_path):
    for part, config in (("build", {"filter": {}}), ("tokenizer", {"tokenizer": {"vocab": 5}}), ("pack", {"pack": {"size": 5}}), ("dedup", {"dedup": {"threshold": 0.5}})):
        with pytest.warns(UserWarning, match=f"unknown {part} settings"), pytest.raises(Exception):  # noqa: B017
            pipeline.run(spark, config | ({"tokenizer": {"model": "other", **config.get("tokenizer", {})}} if part != "dedup" else {"pack": {"dtype": "int8"}}), f"{tmp_path}/x", sample=True)
    with pytest.warns(UserWarning, match="unknown source settings: columns"):
        readers.SourceSpec.from_dict({"name": "a", "path": "p", "columns": 1})
    with pytest.raises(ValueError, match="neither"):
        readers.SourceSpec.from_dict({"name": "a"})


def test_threshold_of_the_configuration_counts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(0, base)] + [(n, " ".join("x" if i % step == 3 else f"w{i}" for i in range(60))) for n, step in enumerate((30, 20, 15, 12, 10), 1)]
    docs = spark.createDataFrame(rows, "ord long, text string")
    left = {t: dedup.build_deduper({"method": "minhash", "num_perm": 64, "jaccard_threshold": t, "shingle_size": 2})(docs).count() for t in (0.5, 0.95)}
    assert left[0.5] < left[0.95]


def test_counts_are_observed_in_the_pass_that_writes(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = readers.sample_documents(spark)
    counted = docs.mapInArrow(count, docs.schema)
    want = filters.filter_stats(filters.with_reason(docs)).first().asDict()
    for n, config in enumerate(({}, {"dedup": {"method": "minhash", "num_perm": 64}})):
        stats, reasons = pipeline.write_curated(counted, config, f"{tmp_path}/{n}")
        assert stats == want and sum(reasons.values()) == want["rejected"]
        assert reasons == {r["reason"]: r["n"] for r in filters.reason_histogram(filters.with_reason(docs)).collect()}
        assert read.value == 9 * (n + 1)
    empty = pipeline.write_curated(docs.where(F.lit(False)), {}, f"{tmp_path}/e")
    assert empty == ({"documents_in": 0, "kept": 0, "rejected": 0}, {})

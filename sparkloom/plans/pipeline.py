"""The corpus build: sources, quality ladder, dedup, clean corpus, tokenizer, packed splits, report."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.settings import warn_of_unknown
from ..operators import dedup, filters, packing, tokenizer
from ..sources import readers, writers
from ..sources.checkpoint import drop_table, materialize

END_TOKEN = "<|endoftext|>"
#: Keys of the public configuration, part by part; sources and filters check their own.
PARTS = ("sources", "filters", "dedup", "tokenizer", "pack")
TOKENIZER_KEYS = ("train", "vocab_size", "model", "sample_docs", "special_tokens", "out")
PACK_KEYS = ("dtype", "shard_size_tokens", "eot_token", "val_fraction")
# The settings of the sample build and the defaults of the public configuration.
SAMPLE_DOCS = 50_000
SAMPLE_CONFIG = {"dedup": {"method": "minhash", "num_perm": 64, "jaccard_threshold": 0.7, "shingle_size": 3}, "tokenizer": {"vocab_size": 512}, "pack": {"val_fraction": 0.0}}


def load_config(path: str | None) -> dict:
    """JSON, or YAML where a parser is installed; the sample's settings without a path."""
    if path is None:
        return dict(SAMPLE_CONFIG)
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def curate(docs: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """Rows marked with their reason, and the clean ones after dedup. Rules run before dedup, which depends on order."""
    marked = filters.with_reason(docs, filters.FilterConfig.from_dict(config.get("filters")))
    return marked, dedup.build_deduper(config.get("dedup"))(marked.where("reason is null").drop("reason"))


def write_curated(docs: DataFrame, config: dict, path: str) -> tuple[dict, dict]:
    """Writes the clean corpus and gives the counts of the rules, which are observed as documents pass: sources are read
    once, also where dedup reads what the rules keep more than once."""
    marked, counted = filters.observed(filters.with_reason(docs, filters.FilterConfig.from_dict(config.get("filters"))))
    kept, deduper = marked.where("reason is null").drop("reason"), dedup.build_deduper(config.get("dedup"))
    if deduper is dedup.keep_all:
        writers.write_clean(kept, path)
    else:
        kept = materialize(kept)
        writers.write_clean(deduper(kept), path)
        drop_table(kept)
    return counted()


def run(spark: SparkSession, config: dict, out_dir: str, sample: bool = False, limit: int | None = None) -> dict:
    """Build everything under ``out_dir`` (any file system Spark writes) and return the report.

    ``config`` has the public keys; one that changes nothing is warned of. ``tokenizer.out`` is where the tokenizer is
    written or, with ``train: false``, read. ``pack.dtype`` bounds ids: a larger one is an error."""
    config = warn_of_unknown("build", config, PARTS)
    settings, pack = warn_of_unknown("tokenizer", config.get("tokenizer"), TOKENIZER_KEYS), warn_of_unknown("pack", config.get("pack"), PACK_KEYS)
    dedup.build_deduper(config.get("dedup"))  # a wrong method is an error before anything is read
    if settings.get("model", "bpe") != "bpe":
        raise ValueError(f"unknown tokenizer model {settings['model']!r}")
    dtype = pack.get("dtype", "uint16")
    if dtype not in ("uint16", "uint32"):
        raise ValueError(f"unknown token type {dtype!r}")
    docs = readers.sample_documents(spark) if sample else readers.read_mixture(spark, [readers.SourceSpec.from_dict(s) for s in config["sources"]], limit)
    stats, reasons = write_curated(docs, config, f"{out_dir}/clean")
    clean = readers.read_clean(spark, f"{out_dir}/clean")
    kept = clean.count()
    end_token = pack.get("eot_token", END_TOKEN)
    if settings.get("train", True):
        special = tuple(settings.get("special_tokens", (END_TOKEN,)))
        coder = tokenizer.train_tokenizer(clean, settings.get("vocab_size", 32_000), special, settings.get("sample_docs", SAMPLE_DOCS))
        writers.write_text_file(spark, coder.to_json(), settings.get("out") or f"{out_dir}/tokenizer.json")
    else:
        coder = tokenizer.Tokenizer.from_json(readers.read_text_file(spark, settings["out"]))
    end_id = coder.token_id(end_token)
    room = min(coder.vocab_size, 1 << 16) if dtype == "uint16" else coder.vocab_size
    encoded = packing.with_end_token(tokenizer.encode_documents(clean, coder), end_id, room)
    split = packing.split_of(F.col("ord"), pack.get("val_fraction", 0.0005))
    rows = packing.stream_offsets(encoded.select("ord", "ids", F.size("ids").cast("long").alias("n_tokens"), split.alias("split")), "ord", "n_tokens", "split")
    rows = packing.shards(rows, pack["shard_size_tokens"]) if pack.get("shard_size_tokens") else rows.withColumn("shard", F.lit(0).cast("long"))
    writers.write_packed(rows, f"{out_dir}/packed", dtype)
    manifest = packing.manifest(rows, coder.vocab_size, end_id).first().asDict() | {"dtype": dtype}
    report = {"out_dir": out_dir, "sample": sample, "stats": {"documents_in": stats["documents_in"], "filter": {"kept": stats["kept"], "rejected": stats["rejected"], "by_reason": reasons}, "dedup": {"method": (config.get("dedup") or {}).get("method", "none"), "seen": stats["kept"], "duplicates_removed": stats["kept"] - kept, "kept": kept}}, "manifest": manifest}
    writers.write_text_file(spark, writers.report_json(manifest), f"{out_dir}/manifest.json")
    writers.write_text_file(spark, writers.report_json(report), f"{out_dir}/report.json")
    return report


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config")
    parser.add_argument("--sample", action="store_true")
    parser.add_argument("--out", default=os.path.join(os.getcwd(), "corpus"))
    parser.add_argument("--limit", type=int)
    options = parser.parse_args(args)
    spark = SparkSession.builder.appName("corpus").getOrCreate()
    print(writers.report_json(run(spark, load_config(options.config), options.out, options.sample, options.limit)))


if __name__ == "__main__":
    main()

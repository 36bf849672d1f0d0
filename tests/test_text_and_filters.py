"""Text features against Python's own string methods, and the ladder at its thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators import filters

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
TEXTS = ["", "\n", "\n\n", "a\n", "a\r\nb", "a\rb", "a\x0bb\x0cc", "a\x1cb", "a\x85b", "a b ", "  x  ", "​x﻿ y", "ß é 中文 ٣ Ⅷ ² 😀", ". .. ... .... ...... ....... # … ##", "a\na\nb\n\n a \nc", "w".join(SPACES) + "w", "".join(SPACES), "\x1f a \x1f b\n\x1f"]


def python_features(x):
    words, lines = x.split(), x.splitlines() or [x]
    full = [s.strip() for s in x.splitlines() if s.strip()]
    return {"chars": len(x), "words": len(words), "symbols": x.count("#") + x.count("...") + x.count("…"), "alpha": sum(map(str.isalpha, x)) / len(x) if x else 0.0, "alnum": sum(map(str.isalnum, x)) / len(x) if x else 0.0, "dup": 0.0 if len(full) <= 1 else (len(full) - len(set(full))) / len(full), "line": sum(map(len, lines)) / len(lines), "normal": " ".join(words), "strip": x.strip(), "mean": sum(map(len, words)) / len(words) if words else None}


def test_features_equal_python(spark):
    assert sorted(SPACES) == sorted(t.WS_CHARS)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(SPACES + list("ab#.…é1")) for _ in range(rng.randrange(40))) for _ in range(300)]
    x = F.col("text")
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i long, text string").select("i", F.length(x).alias("chars"), t.word_count(x).alias("words"), t.symbol_count(x).alias("symbols"), t.alpha_fraction(x).alias("alpha"), t.alnum_fraction(x).alias("alnum"), t.duplicate_line_fraction(x).alias("dup"), t.mean_line_length(x).alias("line"), t.normalise_space(x).alias("normal"), t.strip(x).alias("strip"), t.mean_word_length(x).alias("mean"), F.size(t.words(x)).alias("listed"))
    for r in rows.collect():
        want = python_features(texts[r.i])
        assert {k: r[k] for k in want} == pytest.approx(want), repr(texts[r.i])
        assert r.listed == want["words"]


def reasons(spark, rows):
    return [r.reason for r in filters.with_reason(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, text string, kind string")).orderBy("i").collect()]


def test_ladder_at_its_thresholds(spark):
    w = "abcd " * 60
    cases = [
        ("a" * 4 + " abcde" * 33 + "x" * 0, None),
        (w[:199], "too_short"), (w[:200].replace(" ", "z", 0), None),
        ("abcd " * 20_000, None), ("abcd " * 20_000 + "a", "too_long"),
        (" " * 250, "no_words"), ("abc " * 70, None), ("ab " * 90, "mean_word_len_low"), ("a" * 10 + (" " + "a" * 10) * 30, None), (("a" * 11 + " ") * 30, "mean_word_len_high"),
        (("abcd " * 9 + "#abcd ") * 6, None), (("abcd " * 8 + "#abcd ") * 6, "symbol_ratio_high"),
        ("abc1 " * 60, None), ("ab12 " * 60, "alpha_fraction_low"),
        ("\n".join(["abcde fghij abcde fghij"] * 4 + [f"abcde fghij {c * 9}" for c in "abcdef"]), None),
        ("\n".join(["abcde fghij abcde fghij"] * 5 + [f"abcde fghij {c * 9}" for c in "abcdef"]), "dup_lines_high"),
    ]
    assert reasons(spark, [(x, "prose") for x, _ in cases]) == [r for _, r in cases]
    code = [("a" * 200 + "\n" + "a" * 200, None), ("a" * 201 + "\n" + "a" * 201, "code_line_len_high"), (("ab+++\n") * 50, "code_alnum_low"), ("abc\n" * 60, None), ("ab", "too_short")]
    assert reasons(spark, [(x, "code") for x, _ in code]) == [r for _, r in code]
    assert reasons(spark, [("ab " * 90, None), ("ab " * 90, "other"), (None, "prose")])[:2] == ["mean_word_len_low"] * 2


def test_counts_add_up(spark):
    marked = filters.with_reason(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kind", F.lit("prose")))
    stats = filters.filter_stats(marked).first()
    assert stats.kept + stats.rejected == stats.documents_in
    assert sum(r.n for r in filters.reason_histogram(marked).collect()) == stats.rejected


def test_ladder_is_computed_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kind", F.lit("prose"))
    plan = filters.keep_documents(docs).select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("#|") == 1  # the symbols' pattern


def test_config_ignores_unknown_keys():
    assert filters.FilterConfig.from_dict({"min_chars": 5, "other": 1}).min_chars == 5
    assert filters.FilterConfig.from_dict(None) == filters.FilterConfig()

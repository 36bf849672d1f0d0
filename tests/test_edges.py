"""Settings, numbering, splits and BPE at their edges, against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest

from sparkloom.functions import rewards
from sparkloom.operators import filters, packing, tokenizer
from sparkloom.sources import readers


def test_filter_settings_by_their_public_names():
    assert filters.FilterConfig.from_dict({"max_symbol_to_word_ratio": 0.5, "min_chars": 20}).max_symbol_to_word_ratio == 0.5
    with pytest.warns(UserWarning, match="max_symbols"):
        assert filters.FilterConfig.from_dict({"max_symbols": 1}) == filters.FilterConfig()
    assert filters.FilterConfig.from_dict(None) == filters.FilterConfig()


def test_changed_threshold_has_its_effect(spark):
    docs = spark.createDataFrame([("worded # " * 60, "prose")], "text string, kind string")
    reason = lambda c: filters.with_reason(docs, c).first()["reason"]
    assert reason(filters.FilterConfig()) == "symbol_ratio_high"
    assert reason(filters.FilterConfig.from_dict({"max_symbol_to_word_ratio": 0.9})) != "symbol_ratio_high"


def test_numbers_without_gaps(spark, tmp_path):
    rows = [(i, f"text {i}" if i % 4 else None) for i in range(100)]
    spark.createDataFrame(rows, "k long, text string").repartition(9).write.parquet(f"{tmp_path}/a")
    specs = [readers.SourceSpec("a", f"{tmp_path}/a", order_key="k", max_docs=30), readers.SourceSpec("b", f"{tmp_path}/a")]
    got = readers.read_mixture(spark, specs).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(105))
    assert [r.text for r in got[:30]] == [t for _, t in rows if t][:30]
    assert [r.idx for r in got[30:]] == list(range(75)) and {r.source for r in got[30:]} == {"b"}
    assert readers.read_mixture(spark, specs, 5).count() == 10


def slow_word(coder, word):
    ids = [coder.base + b for b in word.encode()]
    while True:
        ranks = [(coder.rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in coder.rank]
        if not ranks:
            return ids
        rank, at = min(ranks)
        ids[at : at + 2] = [coder.base + 256 + rank]


def slow_merges(counts, n_merges, base):
    words = [([base + b for b in w.encode()], n) for w, n in sorted(counts.items())]
    merges = []
    while len(merges) < n_merges:
        pairs = Counter()
        for ids, n in words:
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        new = base + 256 + len(merges)
        merges.append(best)
        out = []
        for ids, n in words:
            made, i = [], 0
            while i < len(ids):
                hit = tuple(ids[i : i + 2]) == best
                made.append(new if hit else ids[i])
                i += 2 if hit else 1
            out.append((made, n))
        words = out
    return merges


def test_merges_and_words_equal_plain_loops():
    rng = random.Random(3)
    counts = Counter("".join(rng.choice("aabbc ") for _ in range(rng.randrange(1, 9))) for _ in range(400))
    merges = tokenizer.train_merges(dict(counts), 60, 1)
    assert merges == slow_merges(dict(counts), 60, 1)
    coder = tokenizer.Tokenizer(merges, ["<|endoftext|>"])
    for _ in range(300):
        word = "".join(rng.choice("aabbcé ") for _ in range(rng.randrange(0, 40)))
        assert coder._word(word) == slow_word(coder, word)
    assert coder.decode(coder._word("ab" * 100_000)) == "ab" * 100_000


def test_sequential_split_draws_in_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "ORDER_BLOCK", 16)
    docs = spark.createDataFrame([(3 * i,) for i in range(100)], "ord long").repartition(5)
    got = [r.split for r in packing.sequential_split(docs, "ord", 0.3, 0).orderBy("ord").collect()]
    assert got == np.where(np.random.default_rng(0).random(100) < 0.3, "val", "train").tolist()


def test_crops_of_a_stream(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3]), (3, []), (3, [4, 5]), (5, [6, 7, 8, 9])], "pos long, ids array<int>")
    starts = spark.createDataFrame([(i,) for i in range(8)], "start long")
    got = {r.start: (r.x, r.y) for r in packing.crops(rows, starts, 3).collect()}
    assert got == {i: ([i + 1, i + 2, i + 3], [i + 2, i + 3, i + 4]) for i in range(6)}


def test_numbers_in_any_digits(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("١٢٣",), ("-４５.５",), ("𝟙𝟚",), ("none",), (None,)], "x string")
    assert [r[0] for r in rows.select(rewards.to_number(F.col("x"))).collect()] == [123.0, -45.5, 12.0, None, None]

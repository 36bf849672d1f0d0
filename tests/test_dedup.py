"""MinHash against integers of any size, and the greedy resolution against a sequential model."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dedup
from sparkloom.sources.checkpoint import shared_folder


def sequential(signed, n_bands, rows, threshold):
    owner, dropped = {}, set()
    for d, s in sorted(signed.items()):
        keys = [(b, tuple(s[b * rows : b * rows + rows])) for b in range(n_bands)]
        met = {owner[k] for k in keys if k in owner}
        if any(np.mean([x == y for x, y in zip(s, signed[o], strict=True)]) >= threshold for o in met):
            dropped.add(d)
        else:
            for k in keys:
                owner.setdefault(k, d)
    return dropped


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_equals_a_sequential_pass(spark, seed):
    rng = random.Random(seed)
    signed = {}
    for d in range(60):
        base = list(signed[rng.choice(list(signed))]) if signed and rng.random() < 0.7 else [rng.randrange(3) for _ in range(8)]
        signed[d] = [x if rng.random() < 0.8 else rng.randrange(3) for x in base]
    df = spark.createDataFrame(list(signed.items()), "doc_id long, sig array<bigint>")
    folder = Path(shared_folder(spark))
    before = set(folder.glob("t-*"))
    assert {r.doc_id for r in dedup.greedy_duplicates(df, 4, 2, 0.75).collect()} == sequential(signed, 4, 2, 0.75)
    assert len(set(folder.glob("t-*")) - before) == 1  # the result's own table


@pytest.mark.parametrize(("places", "threshold", "levels"), [(8, 0.75, 1), (8, 0.75, 2), (16, 0.8, 2), (8, 1.0, 2)])
def test_links_equal_all_pairs(spark, places, threshold, levels):
    rng = random.Random(places)
    signed = {0: [rng.randrange(3) for _ in range(places)]}
    for d in range(1, 150):
        base = signed[rng.choice(list(signed))] if rng.random() < 0.8 else [rng.randrange(3) for _ in range(places)]
        signed[d] = [x if rng.random() < 0.9 else rng.randrange(3) for x in base]
    owner = {tuple(s): d for d, s in reversed(signed.items())}
    want = {(owner[tuple(s)], d, 1.0) for d, s in signed.items() if owner[tuple(s)] != d}
    agree = {(a, b): np.mean(np.equal(s, t)) for s, a in owner.items() for t, b in owner.items() if a < b}
    want |= {(a, b, x) for (a, b), x in agree.items() if x >= threshold}
    df = spark.createDataFrame(list(signed.items()), "doc_id long, sig array<bigint>").repartition(5)
    got = [tuple(r) for r in dedup.signature_links(df, places, threshold, levels).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    assert dedup.signature_links(df.limit(0), places, threshold, levels).isEmpty()


def test_section_keys_refuse_a_threshold_that_links_all():
    with pytest.raises(ValueError):
        dedup.section_keys(16, 0.0)


def test_permutations_in_longs(spark):
    rng = random.Random(1)
    xs = [0, 1, (1 << 32) - 1] + [rng.randrange(1 << 32) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x bigint")
    for a, b in [((1 << 32) - 2, (1 << 32) - 2), (1, 0), (rng.randrange(1, 1 << 32), rng.randrange(1 << 32))]:
        assert [r[0] for r in df.select(dedup.permuted(F.col("x"), a, b)).collect()] == [(a * x + b) % dedup.PRIME for x in xs]


def test_bands():
    assert [dedup.optimal_bands(*x) for x in [(128, 0.8), (64, 0.7), (64, 0.6), (256, 0.5)]] == [(8, 16), (8, 8), (16, 4), (64, 4)]


def test_signatures_estimate_jaccard(spark):
    a = "one two three four five six seven eight nine"
    rows = [(1, a), (2, a), (3, "ten eleven twelve thirteen fourteen fifteen"), (4, ""), (5, "one")]
    for sign in (dedup.signatures, dedup.signatures_blake2b):
        s = {r.doc_id: r.sig for r in sign(spark.createDataFrame(rows, "doc_id long, text string"), 64, 2).collect()}
        assert s[1] == s[2] and np.mean(np.array(s[1]) == np.array(s[3])) < 0.2
        assert s[4] == [dedup.PRIME] * 64 and len(s[5]) == 64


def test_near_and_exact_copies_go(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(0, text), (1, text.replace("word7 ", "other ")), (2, text), (3, " ".join(f"else{i}" for i in range(300))), (4, "  " + text.replace(" ", "\t"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in dedup.minhash_dedup(docs, 64, 0.6, 3).collect()} == {0, 3}
    assert {r.doc_id for r in dedup.exact_dedup(docs).collect()} == {0, 1, 3}


def test_factory():
    same = object()
    assert dedup.build_deduper(None)(same) is same and dedup.build_deduper({"enabled": False})(same) is same
    with pytest.raises(ValueError):
        dedup.build_deduper({"method": "other"})

"""Batched BLAKE2b against hashlib, signatures against a text-by-text model, letters against Python's own."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators import blake2b, dedup


def model(text, k, a, b):
    w = (text or "").split()
    shingles = {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())
    hashes = [int.from_bytes(hashlib.blake2b(s.encode(), digest_size=4).digest(), "big") for s in shingles]
    return [min(((x * h + y) % dedup.PRIME for h in hashes), default=dedup.PRIME) for x, y in zip(a, b, strict=True)]


def test_hashes_of_a_hundred_thousand_slices():
    rng = np.random.default_rng(3)
    buffer = rng.integers(0, 256, 400_000, dtype=np.uint8)
    lengths = np.concatenate([np.arange(0, 600), rng.integers(1, 90, 99_300), [127, 128, 129, 255, 256, 257, 5000, 40_000], rng.integers(1000, 1100, 92)])
    starts = rng.integers(0, len(buffer) - lengths + 1)
    want = [int.from_bytes(hashlib.blake2b(buffer[s : s + n].tobytes(), digest_size=4).digest(), "big") for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    assert len(want) == 100_000 and blake2b.hashes32(buffer, starts, lengths).tolist() == want


@pytest.mark.parametrize("k", [1, 5])
def test_signatures_of_batches(spark, monkeypatch, k):
    monkeypatch.setattr(blake2b, "TEXT_BYTES", 3000)
    monkeypatch.setattr(blake2b, "PERMUTED", 64)
    rng = random.Random(k)
    words = ["".join(rng.choices("abcäλ漢𝒳", k=rng.choice([1, 3, 8, 40]))) for _ in range(300)]
    texts = [rng.choice(["", " ", "　\n"]) + rng.choice([" ", "\t\n", "\xa0"]).join(rng.choices(words, k=rng.choice([0, 1, k - 1, k, k + 1, 60, 900]))) for _ in range(60)]
    texts += [None, "", " \n", "x" * 9000 + " a b c d e f", texts[5], texts[5]]
    a, b = dedup.permutations(16)
    got = blake2b.signatures_of(texts, k, np.array(a, np.uint64), np.array(b, np.uint64))
    want = [model(x, k, a, b) for x in texts]
    assert got.tolist() == want and blake2b.signatures_of([], k, np.array(a, np.uint64), np.array(b, np.uint64)).shape == (0, 16)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.sig for r in dedup.signatures_blake2b(docs, 16, k).collect()} == dict(enumerate(want))
    assert dedup.signatures_blake2b(docs.limit(0), 16, k).count() == 0


def test_letters_and_numbers_of_every_code_point(spark):
    assigned = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    rows = spark.createDataFrame([(c, chr(c)) for c in assigned], "c int, s string")
    got = {r.c: (r.a, r.n) for r in rows.select("c", t.alpha_fraction(F.col("s")).alias("a"), t.alnum_fraction(F.col("s")).alias("n")).collect()}
    wrong = [hex(c) for c in assigned if got[c] != (float(chr(c).isalpha()), float(chr(c).isalnum()))]
    assert wrong == [] or unicodedata.unidata_version != "15.1.0"

"""Packing across segments and at the end of a range; ids and cache of long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from test_texts import check_packing

from sparkloom.llm import bpe, packing


def prose(n, seed, longest=400):
    rng = random.Random(seed)
    words = "the old mill stands by water and nobody remembers who built it".split()
    return {i: "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(rng.randrange(longest))) for i in range(n)}


def test_documents_that_span_segments(spark, monkeypatch):
    texts = prose(60, 1)
    rows = []
    monkeypatch.setattr(packing, "SEGMENT_TOKENS", 700)
    columns = [pa.array([0] * len(texts), pa.int32()), pa.array(list(texts), pa.int64()), pa.array(list(texts.values()), pa.string())]
    table = pa.RecordBatch.from_arrays(columns, names=["range", "id", "text"])
    for batch in packing._pack(iter([table]), "byte_bpe_50k.json", 256, 1):
        rows += batch.to_pylist()
    for r in rows:
        r["doc_id"], r["doc_tokens"], r["sequence_id"], r["offset"] = r.pop("id"), r.pop("tokens"), r.pop("sequence"), r.pop("place")
    check_packing([type("Piece", (), r) for r in rows], texts, 256)
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order) and len({r["sequence_id"] for r in rows}) > 20


def pieces(docs):
    return sorted((r.doc_id is not None, r.doc_id, r.start, r.length, bytes(r.ids), r.sequence_id, r.offset) for r in packing.pack_documents(docs).collect())


def test_one_rule_for_any_partitioning(spark, monkeypatch):
    """Eleven ranges, some bounds inside one id of many texts: two actions and other files, cores and orders agree."""
    monkeypatch.setattr(packing, "partitions_for", lambda size: 11)
    rows = [*prose(500, 2, 60).items(), *[(7, t) for t in prose(160, 3, 60).values()], (None, "no id"), (None, None), (9, "twice"), (9, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    packed = packing.pack_documents(docs)
    got = pieces(docs)
    assert len({r[5] >> 40 for r in got}) == 11
    assert sorted((r.doc_id is not None, r.doc_id, r.start, r.length, bytes(r.ids), r.sequence_id, r.offset) for r in packed.collect()) == got
    assert len({r.sequence_id >> 40 for r in packed.where("doc_id = 7").collect()}) > 1
    random.Random(4).shuffle(rows)
    for other in (docs.coalesce(1), spark.createDataFrame(rows, "doc_id long, text string").repartition(3)):
        assert pieces(other) == got


def test_ranges_are_those_of_the_sorted_keys():
    rng = np.random.default_rng(5)
    ids, hashes = rng.integers(-4, 5, 900), rng.integers(-9, 10, 900)
    keys = sorted(zip(rng.integers(-4, 5, 12).tolist(), rng.integers(-9, 10, 12).tolist()))
    got = packing.range_of(ids, hashes, (np.array([k for k, _ in keys]), np.array([h for _, h in keys])))
    assert got.tolist() == [sum(k <= x for k in keys) for x in zip(ids.tolist(), hashes.tolist())]


def test_partitions_follow_the_text():
    assert [packing.partitions_for(x) for x in (0, 10**6, 25 * 10**6, 10**14)] == [1, 1, 9, 215_444]


def test_the_end_of_a_range_is_cut_by_the_program():
    def slow(places, penalties, length):
        best = [0] + [None] * (len(places) - 1)
        for j in range(1, len(places)):
            widths = [(places[j] - places[i], best[i]) for i in range(j) if places[j] - places[i] <= length]
            best[j] = min(b + (0 if w & (w - 1) == 0 and w < length else length - w) for w, b in widths) + penalties[j]
        return best[-1]

    rng = random.Random(6)
    for _ in range(40):
        ends = np.cumsum([rng.randrange(1, 60) for _ in range(60)])
        documents = np.array(sorted({*rng.sample(ends.tolist(), 9), int(ends[-1])}))
        places, penalties = packing.cut_places(ends, documents, True)
        cuts, cost, at = packing.window_cuts(places, penalties, 2048, True, (*packing.SHORT, *packing.LAST_SHORT)), 0, 0
        for c in cuts:
            w = c - at
            cost += (0 if w & (w - 1) == 0 and w < 2048 else 2048 - w) + penalties[places.index(c)]
            at = c
        assert at == places[-1] and cost == slow(places, penalties, 2048)


def test_long_texts_and_the_cache():
    from tokenizers import Tokenizer

    coder, library = bpe.codec("word_bpe_49k.json"), Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    long = " ".join(f"Wörter{i % 977} water.mill" for i in range(260_000))  # more than one slice of 4 MB
    unspaced = "水は低きに流れる" * 300
    for text in (long, unspaced, "x" * 5000):
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*coder.young, *coder.old])) <= bpe.CACHE_LENGTH

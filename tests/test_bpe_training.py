"""Training in Spark against the merges one by one, and encoding by words against merges of one word."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import bpe_training, tokenizer


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "pretoken string, n long").repartition(3)


def words(seed, n, letters, longest):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))): rng.randrange(1, 60) for _ in range(n)}


@pytest.mark.parametrize(("counts", "n", "base"), [
    (words(1, 300, "abc", 9), 60, 0), (words(2, 200, "aab", 14), 40, 1), (words(3, 400, "etaoin é", 10), 80, 2),
    ({"aaaa": 3, "aaa": 2, "aa": 1, "baab": 5}, 20, 0), ({"ab": 1}, 5, 0), ({"x": 4, "": 2}, 3, 0),
])
def test_merges_are_those_made_one_by_one(spark, monkeypatch, counts, n, base):
    monkeypatch.setattr(bpe_training, "BLOCK_BYTES", 600)  # several blocks and parts
    monkeypatch.setattr(bpe_training, "CUT_ROUNDS", 3)
    got = bpe_training.train(table(spark, counts), n, base)
    want = tokenizer.train_merges({w: c for w, c in counts.items() if w}, n, base)
    assert [m[:2] for m in got] == want and all(c > 0 for _, _, c in got)


def test_no_words_no_merges(spark):
    assert bpe_training.train(table(spark, {"a": 1}).limit(0), 5, 0) == []
    assert bpe_training.train(table(spark, {"aa": 1}), 0, 0) == []


def test_a_round_stops_before_what_a_merge_may_change():
    pair = lambda a, b: a << 32 | b
    found = [(-90, pair(1, 2)), (-80, pair(5, 6)), (-70, pair(2, 9)), (-60, pair(7, 8))]
    assert bpe_training.choose(found, {pair(1, 2): 10, pair(5, 6): 10}, 9) == [(1, 2), (5, 6)]  # (2, 9) shares a place
    assert bpe_training.choose(found, {pair(1, 2): 80}, 9) == [(1, 2)]  # a new pair may be as frequent
    assert bpe_training.choose(found, {}, 9) == [(1, 2)]  # nothing known of its triples
    assert bpe_training.choose(found, {pair(1, 2): 10, pair(5, 6): 10}, 1) == [(1, 2)]


def test_words_at_once_are_words_one_by_one():
    counts = words(5, 300, "abcd ", 30)
    coder = tokenizer.Tokenizer(tokenizer.train_merges(counts, 90, 1), ["<|endoftext|>"])
    some = [w.encode() for w in [*counts, "", "aaaa", "é😀", "zzz", "abab" * 50]]
    assert [x.tolist() for x in bpe_training.encode_words(some, coder.merges, coder.base)] == [coder._word(w.decode()) for w in some]
    assert bpe_training.encode_words([], coder.merges, 1) == [] and [x.tolist() for x in bpe_training.encode_words([b"", b"ab"], [], 1)] == [[], [98, 99]]


def test_dictionary_and_batches_encode_alike(spark, monkeypatch):
    monkeypatch.setattr(tokenizer, "HOT_SHARE", 8)  # some pre-tokens are hot here
    rng = random.Random(8)
    texts = [None, "", " ", "the the the  end\n\n", "héllo 😀", "x" * 5000] + [" ".join(rng.choice(["the", "a", "word", "other", str(rng.randrange(50))]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    coder = tokenizer.train_tokenizer(docs, 330, order_col="doc_id")
    words_ = tokenizer.word_dictionary(tokenizer.pretoken_counts(docs), coder)
    joined = {r.doc_id: r.ids for r in tokenizer.encode_by_dictionary(docs, words_).collect()}
    dealt = {r.doc_id: r.ids for r in tokenizer.encode_documents(docs, coder).collect()}
    plain = {i: [x for w in coder.pattern.findall(t or "") for x in coder._word(w)] for i, t in enumerate(texts)}
    assert joined == dealt == plain
    assert [coder.decode(x) for x in plain.values()] == [t or "" for t in texts]


def test_first_documents_in_order(spark):
    docs = spark.range(50).select((49 - F.col("id")).alias("ord"))
    assert sorted(r.ord for r in tokenizer.first_documents(docs, 7, "ord").collect()) == list(range(7))
    assert tokenizer.first_documents(docs.limit(0), 7, "ord").isEmpty()


def test_long_words_take_the_heap(monkeypatch):
    coder = tokenizer.Tokenizer(tokenizer.train_merges({"abab": 5, "cab": 3}, 4, 0), [])
    text = "abcab" * 900
    assert len(text) > tokenizer.LONG and np.array_equal(coder.encode_all([text])[0], coder._word(text))
    assert text not in coder.cache


def test_a_part_of_the_table_sums_as_counts_come(monkeypatch):
    """What blocks send to a part is not held until the last of them is there."""
    monkeypatch.setattr(bpe_training, "FOLD", 50)
    held = []
    fold = bpe_training.Sum.fold
    monkeypatch.setattr(bpe_training.Sum, "fold", lambda self: held.append(self.size) or fold(self))
    rng = np.random.default_rng(3)
    sent = [(0, (bool(i % 2), bpe_training.Counts(np.unique(rng.integers(0, 40, 20)), np.zeros(0, dtype=np.int64)))) for i in range(60)]
    sent = [(p, (t, bpe_training.Counts(c.pairs, rng.integers(-2, 9, len(c.pairs))))) for p, (t, c) in sent]
    (news,) = bpe_training._gathered(iter(sent))
    for tag, got in news:
        want = {}
        for _, (t, c) in sent:
            for pair, n in zip(c.pairs.tolist(), c.n.tolist(), strict=True):
                want[pair] = want.get(pair, 0) + n * (t == tag)
        assert dict(zip(got.pairs.tolist(), got.n.tolist(), strict=True)) == {p: n for p, n in want.items() if p in set(got.pairs.tolist())} and set(want) >= set(got.pairs.tolist())
        assert sum(want.values()) == got.n.sum()
    assert max(held) <= 50 + 40 and len(held) > 10


def test_texts_are_encoded_by_slices_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tokenizer, "SLICE", 100)
    coder = tokenizer.Tokenizer(tokenizer.train_merges({"abab": 5, "cab": 3}, 4, 0), [])
    texts = [None, "", "abab cab" * 5, "é" * 300, "x", *(["cab abab"] * 40), None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    parts = list(tokenizer.slices(batch, "text"))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 100 for p in parts)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids string").coalesce(1)
    out = tokenizer.decode_documents(tokenizer.encode_documents(docs, coder), coder)
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and dict(out.dtypes)["ids"] == "array<int>"
    rows = out.collect()
    assert [(r.doc_id, r.text) for r in rows] == list(enumerate(texts))
    assert [r.decoded for r in rows] == [t or "" for t in texts] and [r.ids for r in rows] == [coder.encode(t or "") for t in texts]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan

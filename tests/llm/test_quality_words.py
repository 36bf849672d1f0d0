"""Quality: words and their order count, the forward pass is what its formula says, odd tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import quality
from sparkloom.llm.common import buffers, crc32_mod

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, "quality", lambda i: crc32_mod(i, 3) != 1)
    held = [r for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    return model, held


def scores(model, texts):
    return model.score(*quality.encode_passages(*buffers(pa.array(texts, pa.string()))))


def test_held_out(rows):
    model, held = rows
    got = scores(model, [r.text for r in held]) >= 0.5
    good = np.array([r.quality == 1 for r in held])
    print("held out", len(held), "wrong", (got != good).sum(), "good kept", got[good].mean(), "bad kept", got[~good].mean())
    assert (got == good).mean() > 0.98


def test_damaged_documents_are_bad(rows):
    model, held = rows
    good = [r.text for r in held if r.quality == 1 and len(r.text) > 400][:200]
    rng = np.random.default_rng(8)
    for way in (0, 1):
        kept = (scores(model, [quality.damage(t, way, rng) for t in good]) >= 0.5).mean()
        print("damage", way, "kept", kept)
        assert kept < 0.1
    assert (scores(model, good) >= 0.5).mean() > 0.97


def test_forward_pass_equals_a_loop(rows):
    model, held = rows
    texts = [r.text for r in held[:20]] + ["", None, "word"]
    x, first = quality.encode_passages(*buffers(pa.array(texts, pa.string())))
    p, sigmoid = model.p, lambda v: 1 / (1 + np.exp(-v))
    for i, got in enumerate(model.score(x, first)):
        e, h = [], []
        for row in x[first[i] : first[i + 1]].astype(np.float64):
            hidden = np.tanh(((row - model.mean) * model.scale) @ p["A"] + p["a"])
            e.append(np.exp((np.tanh(hidden @ p["V"]) * sigmoid(hidden @ p["U"])) @ p["w"]))
            h.append(hidden)
        want = sigmoid(np.average(h, axis=0, weights=e) @ p["c"] + p["b"][0])
        assert abs(got - want) < 1e-3


def test_vectors_do_not_depend_on_the_batch(rows):
    texts = [r.text for r in rows[1][:12]] + ["", "x", "A b. C", "é" * 1500]
    whole, first = quality.encode_passages(*buffers(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert np.allclose(whole[first[i] : first[i + 1]], quality.encode_passages(*buffers(pa.array([t], pa.string())))[0], atol=1e-6)


def test_all_passages_of_all_documents_train(spark, monkeypatch):
    """Whole, once each and whatever the length; chunks that are held and chunks that are read anew train alike."""
    docs = spark.createDataFrame([(1, "word " * 3000, "a", 9), (1, "word " * 3000, "a", 9), (2, "x " * 50_000, "b", 9), (3, "tiny", "c", 9), (5, None, "d", 9), (None, "x", "d", 9)], "doc_id long, text string, id string, label int")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, None), (4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    models, seen, learn = [], [], quality.train_chunks

    def watch(chunk, chunks, seed=5):
        seen.append([len(b) for i in range(chunks) for b in chunk(i)[0]])
        models.append(learn(chunk, chunks, seed))
        return models[-1]

    monkeypatch.setattr(quality, "train_chunks", watch)
    monkeypatch.setattr(quality, "EPOCHS", 2)
    monkeypatch.setattr(quality, "CHUNK_BAGS", 2)
    for held in (quality.HELD_BYTES, 0):
        monkeypatch.setattr(quality, "HELD_BYTES", held)
        quality.fit(docs, labels, "quality", lambda i: i > 0)
    assert [sorted(x) for x in seen] == [[1, 1, 30, 196]] * 2
    assert all(np.array_equal(models[0].p[k], models[1].p[k]) for k in models[0].p)
    assert quality.fit(docs, labels.limit(0), "quality", lambda i: i > 0) is None
    assert quality.fit(docs.where("doc_id = 77"), labels, "quality", lambda i: i > 0) is None


def test_training_bags_stay_out_of_memory(spark, monkeypatch):
    """The driver holds a few bags at a time, and they are read from the table once, not once an epoch."""
    import tracemalloc

    docs = spark.createDataFrame([(i, "word other " * 4000) for i in range(60)], "doc_id long, text string")  # some 12 MB of bags
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, quality int")
    seen, learn = [], quality.train_chunks

    def watch(chunk, chunks, seed=5):
        tracemalloc.start()
        monkeypatch.setattr(type(docs), "toArrow", None)
        bags = [chunk(i)[0] for i in range(chunks)]
        seen.extend((sum(b.nbytes for bag in bags for b in bag), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
        return learn(chunk, chunks, seed)

    monkeypatch.setattr(quality, "train_chunks", watch)
    monkeypatch.setattr(quality, "EPOCHS", 2)
    monkeypatch.setattr(quality, "CHUNK_BAGS", 16)
    quality.fit(docs, labels, "quality", lambda i: i >= 0)
    assert seen[0] > 10 << 20 > 8 * seen[1]

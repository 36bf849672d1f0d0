"""What a step of a classifier or of the n-gram join holds has a bound far below an executor's memory."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import language_id, ngram_join, quality


def _texts(rows: int) -> pa.RecordBatch:
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 9, 2000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 200)) for _ in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def _quality_model() -> quality.AttentionModel:
    rng = np.random.default_rng(2)
    bags = [rng.random((2, quality.FEATURES), dtype=np.float32) for _ in range(8)]
    return quality.train(bags, np.arange(8) % 2.0)


def _language_model() -> language_id.KernelModel:
    bits = np.random.default_rng(3).random((64, language_id.BUCKETS)) < 0.1
    return language_id.train(bits, [f"l{i % 2}" for i in range(64)])


@pytest.mark.parametrize("step", ["quality", "language", "digest"])
def test_a_batch_of_two_megabytes_takes_little_memory(step):
    batch = _texts(2000)
    if step == "quality":
        run = quality._keep(iter([batch]), SimpleNamespace(value=_quality_model()), 0.0, 1)
    elif step == "language":
        run = language_id._keep(iter([batch]), SimpleNamespace(value=_language_model()), 0.0, 1)
    else:
        run = ngram_join._digest(iter([batch]), 5, 80, SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.uint8))))
    tracemalloc.start()
    try:
        for _ in run:
            pass
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 48, f"{step}: {peak:.0f} MB"


def test_quality_hands_on_rows_step_by_step():
    batch, model = _texts(2000), SimpleNamespace(value=_quality_model())
    every = list(quality._keep(iter([batch]), model, 0.0, 1))
    assert len(every) > 4 and max(b.nbytes for b in every) < batch.nbytes / 4
    assert pa.Table.from_batches(every).equals(pa.Table.from_batches([batch]))
    scores = np.concatenate([np.asarray(b.column(1)) for b in quality._score(iter([batch]), model)])
    kept = pa.Table.from_batches(quality._keep(iter([batch]), model, float(np.median(scores)), 1))
    assert kept["doc_id"].to_pylist() == np.flatnonzero(scores >= np.median(scores)).tolist()
    assert [b.num_rows for b in quality._keep(iter([batch]), SimpleNamespace(value=None), 0.5, 1)] == [2000]

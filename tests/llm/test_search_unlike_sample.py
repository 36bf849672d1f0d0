"""The search on rows of many small clusters, most of which no sample of a bounded size holds."""

import numpy as np
import pytest

from sparkloom.llm import additive_quantization as aq
from sparkloom.llm.vectors import unit


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.1), (300, 0.3)])
def test_block_of_clusters_outside_the_sample(monkeypatch, dim, spread):
    rng = np.random.default_rng(3)
    x = unit((rng.normal(size=(500, 1, dim)) + spread * rng.normal(size=(500, 10, dim))).reshape(-1, dim)[rng.permutation(5000)])
    model = aq.AdditiveQuantizer.fit(x[:600])
    codes = model.encode(x)
    near = model.decode(codes)
    norms = np.linalg.norm(near, axis=1).astype(float)
    block = aq._Block(model, 5, dim)
    block.parts = [(np.arange(5000), x, codes, norms, np.linalg.norm(x - near / norms[:, None], axis=1))]
    asks = np.arange(0, 5000, 50)
    got = set(zip(*(c.tolist() for c in block.search(asks, x[asks])[:2]), strict=True))
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -2
    want = {(q, i) for q, row in zip(asks.tolist(), np.argsort(-score, axis=1)[:, :5].tolist(), strict=True) for i in row}
    assert len(got & want) >= 0.98 * len(want)


def test_a_query_unlike_the_sample_visits_the_cells_between_which_it_lies():
    rng = np.random.default_rng(4)
    tight = unit(np.repeat(rng.normal(size=(20, 64)), 50, axis=0) + 0.001 * rng.normal(size=(1000, 64)))
    cells = aq.Cells(tight, 16, 5)
    strange = unit(rng.normal(size=(40, 64)))
    assert np.mean([len(v) for v in cells.visited(tight)]) < 6 and np.mean([len(v) for v in cells.visited(strange)]) > cells.probes + 2

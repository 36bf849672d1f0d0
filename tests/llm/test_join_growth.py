"""The join's work as tables grow: what the bound lets through, and what is shuffled."""

import numpy as np
import pytest

from sparkloom.llm import graph
from sparkloom.llm import ngram_join as nj


@pytest.mark.parametrize(("n", "percent"), [(60, 90), (650, 90), (3000, 90), (650, 80)])
def test_bound_parts_sets_that_lack_a_quarter(n, percent):
    """Else chains of mistaken links make one component of most sets of a large table."""
    rng = np.random.default_rng(1)
    passed, near = 0, 0
    for _ in range(300):
        tokens = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a = tokens[:n]
        for start, count in ((n // 4, "far"), (max(1, n // 100), "near")):
            both = [nj.unpack_counts(nj.pack_counts(nj.group_counts(s, nj.groups_of(n, percent)))) for s in (a, tokens[start : start + n])]
            linked = len(nj.bound_block(np.array([1, 2]), np.array([n, n]), both, percent)[0])
            passed, near = passed + linked * (count == "far"), near + linked * (count == "near")
    assert near == 300 and passed <= 3


def test_small_groups_equal_the_tree(monkeypatch):
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 1 << 40, 90).astype(np.uint64)
    for _ in range(50):
        sets = [np.unique(rng.choice(tokens, rng.integers(70, 90), replace=False)) for _ in range(rng.integers(3, 12))]
        counts = [nj.group_counts(s, nj.groups_of(len(s), 90)) for s in sets]
        block = (np.arange(len(sets)), np.array([len(s) for s in sets]), counts, 90)
        some = nj.bound_block(*block)
        with monkeypatch.context() as m:
            m.setattr(nj, "LEAF", 0.5)  # no group is small
            m.setattr(nj.CountRTree, "__init__", _one_leaf)
            assert [x.tolist() for x in some] == [x.tolist() for x in nj.bound_block(*block)]


def _one_leaf(self, points, sizes):
    self.points, self.sizes = points, sizes
    self.leaves, self.nodes = [np.arange(len(points))], [np.array([0])]
    self.high = self.node_high = points.max(axis=0)[None, :]
    self.least = self.node_least = np.array([sizes.min()])
    self.most = self.node_most = np.array([sizes.max()])


@pytest.mark.parametrize("counts", [[0, 15, 3, 7], [0, 16, 3, 7], [300, 0, 0, 1], [70_000, 1, 2, 3]])
def test_counts_are_kept(counts):
    assert nj.unpack_counts(nj.pack_counts(np.array(counts))).tolist() == counts


@pytest.mark.parametrize("few", [graph.FEW_EDGES, 0])
def test_few_edges_take_few_jobs(spark, monkeypatch, few):
    """A round's plans cost the driver some twenty jobs; tables that one task can hold need none, all others go by rounds."""
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = np.random.default_rng(4)
    edges = [(int(i), int(i) + 1) for i in rng.permutation(200) if i % 50 < 40] + [(1000, 3), (900, 900), (3, 1000), (None, 5)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup(group := f"components-{few}", "")
    try:
        got = [tuple(r) for r in graph.connected_components(table, "a", "b").collect()]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {50 * c + i: 50 * c for c in range(4) for i in range(41)} | {1000: 0}
    assert sorted(got) == sorted(want.items())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert jobs <= 8 if few else jobs > 8
    assert graph.connected_components(table.where("a < 0"), "a", "b").isEmpty()

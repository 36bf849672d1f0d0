"""Exact token shares against a sequential pass; seekable epochs are permutations that batches agree with."""

import hashlib

import numpy as np
import pytest

from sparkloom.functions import epochs
from sparkloom.sources import shares


def sequential(rows, targets, seed):
    kept, used, full = set(), dict.fromkeys(targets, 0), set()
    order = lambda i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16)
    for i, s, n in sorted(rows, key=lambda r: order(r[0])):
        if s in targets and s not in full:
            if used[s] + (n or 0) > targets[s]:
                full.add(s)
            else:
                kept.add(i)
                used[s] += n or 0
    return kept, used


@pytest.mark.parametrize("budget", [None, 9000])
def test_each_source_is_within_a_document_of_its_share(spark, budget):
    rng = np.random.default_rng(1)
    rows = [(int(i), "abcd"[int(rng.integers(4))], int(rng.integers(1, 90))) for i in range(1500)]
    rows += [(5000, "a", None), (5001, None, 9), (5002, "unweighted", 9)]
    docs = spark.createDataFrame(rows, "ord long, source string, n long").selectExpr("*", "'x' AS k", "1 AS t")
    weights = {"a": 0.1, "b": 0.3, "c": 0.2, "absent": 0.4, "d": 0.0}
    totals = {s: sum(n or 0 for _, z, n in rows if z == s) for s in "abc"}
    targets = shares.share_targets(totals, weights, budget)
    got = shares.token_shares(docs, weights, "n", seed=3, budget=budget)
    assert got.columns == docs.columns
    kept, used = sequential(rows, targets, 3)
    assert {r.ord for r in got.collect()} == kept
    assert all(0 <= targets[s] - used[s] < 90 for s in targets)
    if budget is None:
        assert any(targets[s] == totals[s] == used[s] for s in targets)
    else:
        assert sum(targets.values()) <= budget


def test_shares_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, "a", 3)], "ord long, source string, n long")
    assert shares.token_shares(docs, {"a": 1}, "n").count() == 3
    assert shares.token_shares(docs, {"a": 1}, "n", budget=7).where("ord = 1").count() == 0
    assert shares.token_shares(docs, {"b": 1}, "n").count() == shares.token_shares(docs, {}, "n").count() == 0
    assert shares.token_shares(docs.limit(0), {"a": 1}, "n").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 9999])
def test_an_epoch_has_every_row_once(n):
    for epoch in range(3):
        rows = epochs.row_at(np.arange(n), n, 4, epoch)
        assert sorted(rows.tolist()) == list(range(n))
    if n > 100:
        assert abs(np.corrcoef(np.arange(n), rows)[0, 1]) < 0.1
        assert (rows != epochs.row_at(np.arange(n), n, 4, 0)).mean() > 0.9


@pytest.mark.parametrize("n", [1, 3, 103, 5003])
def test_batches_read_by_themselves_are_those_of_the_epoch(spark, n):
    rows = spark.range(n).selectExpr("id AS idx", "id * 2 AS v")
    placed = {r.idx: (r.place, r.batch) for r in epochs.epoch_places(rows, n, 10, 8, 2).collect()}
    assert [i for i, _ in sorted(placed.items(), key=lambda x: x[1])] == epochs.row_at(np.arange(n), n, 8, 2).tolist()
    for batch in {0, (n - 1) // 10, n}:
        got = epochs.read_batch(rows, n, 10, batch, 8, 2)
        assert {r.idx: (r.place, batch) for r in got.collect()} == {i: p for i, p in placed.items() if p[1] == batch}
    outside = spark.createDataFrame([(-1,), (n,), (None,)], "idx long")
    assert all(r.place is None for r in epochs.epoch_places(outside, n, 10, 8, 2).collect())


def test_long_walks_are_foreseen():
    lengths = {epochs.longest_walk(n, 1, e) for n in range(2, 60) for e in range(20)}
    assert 0 in lengths and max(lengths) > 1


def test_a_batch_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS idx").write.parquet(f"{tmp_path}/rows")
    plan = epochs.read_batch(spark.read.parquet(f"{tmp_path}/rows"), 1000, 8, 3, 1, 1)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(idx" in plan and "Exchange" not in plan

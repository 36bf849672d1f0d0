"""The search over several cells and blocks, ties across them, and against SQL."""

import duckdb
import numpy as np
import pytest
from test_pairs import vectors

from sparkloom.llm import additive_quantization as aq
from sparkloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("spread", [0.01, 0.3])
def test_recall_over_cells(spark, monkeypatch, spread):
    monkeypatch.setattr(aq, "ROW_BLOCK", 100)
    x = vectors(2000, spread=spread)
    got = aq.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5), lambda i: i % 50 == 0).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    best = set()
    for q in range(0, 2000, 50):
        score = u @ u[q]
        score[q] = -2
        best |= {(q, int(i)) for i in np.argsort(-score)[:5]}
    assert len(got) == len(best) and len(best & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(best)
    assert all(abs(r.score - u[r.query_id] @ u[r.vec_id]) < 1e-12 for r in got)


def test_ties_across_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(aq, "ROW_BLOCK", 60)
    x = vectors(600)
    x[100:400] = x[0]  # copies in one cell, many blocks
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, [9.0] * 16), (7, x[7].tolist())]
    got = aq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect()
    first = sorted(((r["rank"], r.vec_id) for r in got if r.query_id == 0))
    assert first == [(1, 100), (2, 101), (3, 102), (4, 103), (5, 104)]
    assert all(len([r for r in got if r.query_id == q]) == 5 for q in range(0, 600, 50))


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def test_query_against_exhaustive_sql(spark, monkeypatch):
    monkeypatch.setattr(aq, "ROW_BLOCK", 100)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = {(q, v): s for q, _, v, s in con.sql(SQL).fetchall()}
    got = {(r.query_id, r.vec_id): r.score for r in queries.op1_nearest_neighbours(spark, SF).collect()}
    both = want.keys() & got.keys()
    assert len(got) == len(want) and len(both) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-12 for p in both)


def test_copies_of_a_query_do_not_grow_with_the_table(spark, monkeypatch):
    for name, value in {"ROW_BLOCK": 50, "MOST_CELLS": 8, "MOST_BLOCKS": 16}.items():
        monkeypatch.setattr(aq, name, value)
    copies = {}
    for n in (1000, 4000, 16000):
        x = vectors(n, spread=0.3)
        x[: n // 3] = x[0]  # a hot vector, and its cell with many blocks
        index = aq.build_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), 5, "vec_id", "embedding")
        met = aq.meetings(index, lambda i: i % 50 == 0).groupBy("asks", "block").count().collect()
        copies[n] = sum(r["count"] for r in met if r.asks) / (n // 50)
        assert len({r.block for r in met}) <= 8 + 16 and max(r["count"] for r in met if not r.asks) <= 1.5 * max(50, n / 16)
        assert sum(r["count"] for r in met if not r.asks) == n
    assert all(c <= 8 + 16 for c in copies.values()) and copies[16000] <= 1.3 * copies[4000]


def test_rows_in_tiles_equal_rows_at_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(900, spread=0.3))] + [(900 + i, [1.0] * 16) for i in range(60)], "vec_id long, embedding array<float>")
    some = []
    for tile in (4096, 64, 7):
        monkeypatch.setattr(aq, "TILE", tile)
        got = aq.nearest(rows, lambda i: i % 50 == 0).collect()
        assert len(got) == 20 * 5 and sorted(r.vec_id for r in got if r.query_id == 900) == [901, 902, 903, 904, 905]
        some.append({(r.query_id, r.vec_id) for r in got})
    # A tile's own best rows are reranked besides those within the margin, so more tiles find no less.
    assert len(some[0] & some[1]) >= 0.99 * 100 and len(some[0] & some[2]) >= 0.99 * 100

"""The similarity joins and the search against brute force."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from sparkloom.llm import additive_quantization as aq
from sparkloom.llm import embedding_dedup as ed
from sparkloom.llm import ngram_join as nj
from sparkloom.llm.graph import connected_components

SF = "/root/testdata/sf0.001"


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def words_of(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_join(rows, k, percent):
    sets = {i: shingles_of(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    parts = components(ids, links)
    return {(i, len(sets[i]), parts[i]) for i in ids}


def near_copies(n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = words_of(rows[rng.randrange(len(rows))][1])
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                if w:
                    w[rng.randrange(len(w))] = f"w{rng.randrange(50)}"
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 120, 400])))))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, k, percent):
    rows = [*near_copies(), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "ONE "), (1005, "a b"), (1006, "word " * 3000), (1007, "A  B")]
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent)
    assert {tuple(r) for r in got.collect()} == brute_join(rows, k, percent)


def test_join_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = nj.ngram_jaccard_join(docs, k=3, percent=90)
    assert {tuple(r) for r in got.collect()} == brute_join([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 800)
    rows = near_copies(150, 7)
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90)
    assert {tuple(r) for r in got.collect()} == brute_join(rows, 3, 90)


def test_join_of_odd_tables(spark):
    shape = "doc_id long, text string, id long, component_id string, n string"
    assert nj.ngram_jaccard_join(spark.createDataFrame([], shape)).count() == 0
    text, other = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    rows = [(3, text, 1, "x", "y"), (3, text, 1, "x", "y"), (None, text, 1, None, None), (5, text, None, None, None), (5, other, 0, "", ""), (9, other, 0, "", "")]
    got = sorted((tuple(r) for r in nj.ngram_jaccard_join(spark.createDataFrame(rows, shape), k=3, percent=90).collect()), key=str)
    assert got == sorted([(3, 48, 3), (3, 48, 3), (None, 48, None), (5, 48, 3), (5, 48, 3), (9, 48, 3)], key=str)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000), (7, 3), (2001, 2000), (2001, 2000)]
    random.Random(1).shuffle(edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect())
    assert got == {i: 0 for i in range(401)} | {2000: 2000, 2001: 2000}


def vectors(n, dim=16, seed=3, clusters=8, spread=0.01):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 2):
        x[i] = centres[rng.integers(clusters)] + spread * rng.normal(size=dim) * rng.integers(1, 8)
    return x


ODD = [(90_000, None, 1), (90_050, [0.0] * 16, 1), (90_001, [math.nan] + [1.0] * 15, 1), (90_002, [math.inf] + [1.0] * 15, 1), (90_003, [None] + [1.0] * 15, 1), (90_004, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]


def test_search_reaches_recall(spark):
    x = vectors(1500)
    x[700] = x[50] = x[51]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD
    got = aq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3), lambda i: i % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    found = 0
    for q in range(0, 1500, 50):
        score = u @ u[q]
        score[q] = -2
        best = sorted(range(1500), key=lambda i: (-round(score[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(mine, mine[1:]))
        found += len({r.vec_id for r in mine} & set(best))
    assert found >= 0.97 * 5 * 30
    assert {r.query_id for r in got} == set(range(0, 1500, 50))


def test_search_of_small_tables(spark):
    shape = "vec_id long, embedding array<float>, score string"
    assert aq.nearest(spark.createDataFrame([], shape), lambda i: i % 50 == 0).count() == 0
    got = aq.nearest(spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [1e30, 1e30], "b"), (0, [1.0, 0.0], "a"), (2, None, "c")], shape), lambda i: i % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)]
    assert abs(got[0].score - math.sqrt(0.5)) < 1e-7


def brute_duplicates(rows, threshold):
    good = [(i, np.array(v) / np.linalg.norm(v), c) for i, v, c in rows if i is not None and c is not None and v is not None and len(v) == 16 and all(y is not None and math.isfinite(y) for y in v) and any(v)]
    links = [(a, b) for x, (a, v, c) in enumerate(good) for b, w, d in good[x + 1 :] if c == d and v @ w >= threshold]
    parts = components([r[0] for r in rows if r[0] is not None], links)
    return {i: (sum(i in x for x in links), parts[i], parts[i] == i) for i in parts}


@pytest.mark.parametrize("spread", [0.0, 0.03])
def test_near_duplicates_equal_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 50)
    monkeypatch.setattr(ed, "CELL_ROWS", 8)
    x = vectors(700, spread=spread)
    rows = [(i, v.tolist(), None if i % 29 == 0 else i % 2) for i, v in enumerate(x)] + [(800, x[2].tolist(), 0), (801, (2 * x[2]).tolist(), 0), (802, x[2].tolist(), 1)] + ODD
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect() if r.vec_id is not None}
    assert got == brute_duplicates(rows, 0.98)


def test_near_duplicates_of_odd_tables(spark):
    shape = "vec_id long, embedding array<float>, label string, n_links int"
    assert ed.near_duplicates(spark.createDataFrame([], shape)).count() == 0
    rows = [(4, [1.0, 0.0], "a", 9), (4, [1.0, 0.0], "a", 9), (2, [3.0, 0.0], "a", 9), (1, [1.0, 0.0], None, 9)]
    got = sorted(tuple(r) for r in ed.near_duplicates(spark.createDataFrame(rows, shape)).collect())
    assert got == [(1, 0, 1, True), (2, 1, 2, True), (4, 1, 2, False), (4, 1, 2, False)]


def test_embeddings_table(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet")
    x = np.array(rows["embedding"].to_pylist(), dtype=np.float64)
    got = aq.nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), lambda i: i % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u[::50] @ u.T
    s[np.arange(len(s)), np.arange(0, len(u), 50)] = -2
    best = {(50 * q, int(i)) for q in range(len(s)) for i in np.argsort(-s[q])[:5]}
    assert len(best & {(r.query_id, r.vec_id) for r in got}) >= 0.95 * len(best)

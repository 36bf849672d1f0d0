"""Vector codes against a plain reading of their definition in Python's integers, and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from sparkloom.llm import code_compression, queries

SF = "/root/testdata/sf0.001"


def plain(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error of (vec_id, vector, label) rows, in no order, and the digest of the codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = parts * max(1, -(-max((len(v) for _, v, _ in kept), default=1) // parts))
    kept = [(i, v + [0] * (dim - len(v)), label) for i, v, label in kept]
    width = dim // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v, _ in kept:
                held[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for e, h in zip(books[p], held, strict=True)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, by_label[label], digest) for i, c, e, label in out]


def order(rows):
    return sorted(rows, key=repr)


def run(df):
    coded, books = code_compression.compress(df)
    out = code_compression.with_label_error(coded)
    return order((r.vec_id, r.code, r.error, r.label_error, code_compression.codebook_digest(books)) for r in out.collect())


def test_query_equals_definition_and_sql(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = order((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in queries.op13_code_compression(spark, SF).collect())
    assert got == order(plain(rows)) and len(got) == 500
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == order(con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.ORACLE_SQL['op13_code_compression']})").fetchall())


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, id string"


def test_odd_rows_and_any_dealing(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(32)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(3, rows[3][1], 1)] * 3 + [(3, [0.5] * 32, None), (None, [0.25] * 32, 2), (-5, [0.0] * 32, 1), (900, [], 1), (901, [1.5] * 5, None)]
    rows += [(902, None, 1), (903, [None] * 32, 1), (904, [float("nan")] * 32, 1), (905, [float("inf")] + [0.0] * 31, 1)]
    rows += [(910 + i, [0.125] * 32, 7) for i in range(300)]  # one label and one vector with most rows
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    want = order(plain(rows))
    assert run(df.repartition(7)) == want and run(df.coalesce(1)) == want
    assert run(df.limit(0)) == []
    few = rows[:5]
    assert run(df.where("vec_id < 5 and vec_id >= 0").limit(5)) == order(plain(few))


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate([[1e9, -1e9] * 8, [3.5] * 16, [1e9 + 1, 7.0] * 8, [2.5] * 16])]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA.replace("float", "double"))
    assert run(df) == order(plain(rows))
    huge = spark.createDataFrame([(i, [x] * 16, i) for i, x in enumerate([1e308, -1e308, 0.0])] + [(i, [5e307] * 16, 9) for i in range(3, 80)], "vec_id long, embedding array<double>, label int")
    got = run(huge)
    assert len(got) == 80 and max(r[2] for r in got) <= code_compression.LONGEST


def test_blocks_add_up_in_any_order():
    rng = np.random.default_rng(2)
    block, books = rng.integers(-50, 50, (8, 1000)), rng.integers(-50, 50, (2, 5, 4))
    zero = lambda: (np.zeros((2, 5, 4), dtype=np.int64), np.zeros((2, 5), dtype=np.int64))
    whole = code_compression.add_block(zero(), block, books)
    halves = [code_compression.add_block(zero(), np.ascontiguousarray(b), books) for b in (block[:, 600:], block[:, :600])]
    merged = code_compression.merge_sums(*halves)
    assert (whole[0] == merged[0]).all() and (whole[1] == merged[1]).all() and whole[1].sum() == 2000


def test_ties_go_to_the_lower_entry():
    near, far = code_compression.assign(np.array([[0, 2]]), np.array([[1], [-1], [1]]))
    assert near.tolist() == [0, 0] and far.tolist() == [1, 1]
    with pytest.raises(ValueError):
        code_compression.compress(None, entries=300)

"""Rank queue and rank BPE against the library that reads the same file."""

import hashlib
import random
import time

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from sparkloom.llm import queries, rank_bpe

SF = "/root/testdata/sf0.001"
FILE = "byte_bpe_multi_50k.tiktoken"
ODD_TEXTS = [None, "", " ", "\n\n ", "a", "a  b   c", "  lead", "tail \t", "I'll don't 'S 'RE", "x\x1cy \x1f z\x85 q", "²½ Ⅷ 10 ٣٤ १२", "<|endoftext|>", "😀👍🏽 x🇩🇪", "日本語のテキスト。中文", "\ud7ff\ue000\U0010ffff", "e\u0301 ﬁ ǅ", "\u088f\u0c5c \U00011de0 new"]


def library():
    ranks = rank_bpe.read_ranks(P.path(FILE))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    points = lambda: chr(rng.choice([rng.randrange(32, 127), 32, 10, rng.randrange(0xA0, 0x600), rng.randrange(0x900, 0xD800), rng.randrange(0xE000, 0x110000)]))
    return ["".join(points() for _ in range(rng.randrange(1, 60))) for _ in range(n)] + ["".join(rng.choice("aehlnst 'r\n") for _ in range(rng.randrange(1, 200))) for _ in range(n)]


def test_queue_gives_the_lowest_rank_and_its_places_in_order():
    rng = random.Random(3)
    queue, held = rank_bpe.RankQueue(5000), {}
    for _ in range(5000):
        if held and rng.random() < 0.4:
            rank = min(held)
            assert queue.take() == (rank, sorted(held.pop(rank)))
        else:
            rank, place = rng.choice([rng.randrange(5000), 63, 64, 4999, 0]), rng.randrange(10**6)
            held.setdefault(rank, []).append(place)
            queue.push(rank, [place])
    while held:
        rank = min(held)
        assert queue.take() == (rank, sorted(held.pop(rank)))
    assert queue.take() == (-1, []) and not any(queue.buckets) and not any(any(level) for level in queue.levels)


def encode(coder, text):
    return coder.encode([text])[0]


def test_ids_equal_the_library():
    coder, known = rank_bpe.codec(FILE), library()
    for text in [x or "" for x in ODD_TEXTS] + texts(600):
        ids = encode(coder, text)
        assert ids.tolist() == known.encode_ordinary(text), repr(text)
        assert coder.decode(ids)[0].tobytes() == text.encode()


def test_code_points_are_cut_as_the_library_cuts_it():
    coder, known = rank_bpe.codec(FILE), library()
    points = [chr(c) for c in [*range(0x3400), *range(0x3400, 0xD800, 97), *range(0xE000, 0x20000, 3), *range(0x20000, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in points[at : at + 4096])
        assert encode(coder, text).tolist() == known.encode_ordinary(text), hex(at)


def test_ranks_that_fall_after_a_merge():
    """An entry made of a later merge may rank before it; then the queue goes back."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 400, b"abc": 300, b"cd": 350, b"aab": 290, b"aa": 500}
    known = tiktoken.Encoding("toy", pat_str=r"[a-d]+", mergeable_ranks=ranks, special_tokens={})
    coder, rng = rank_bpe.RankEncoder(ranks), random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    for block in (words, words[:1], [*words[:3], "", "ab"]):
        got = [np.frombuffer(x, np.uint32).tolist() for x in coder.encode([w.encode() for w in block])]
        assert got == [known.encode_ordinary(w) for w in block]


def test_long_pretokens_take_time_in_proportion():
    coder, rng = rank_bpe.codec(FILE).encoder, random.Random(7)
    seconds, pieces = [], entries(coder)
    for n in (20_000, 320_000):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(n)).encode()
        began = time.perf_counter()
        ids = np.frombuffer(coder.encode([word])[0], np.uint32)
        seconds.append(time.perf_counter() - began)
        assert b"".join(pieces[i] for i in ids) == word
    assert seconds[1] < 64 * max(seconds[0], 0.01)  # 16 times the length: 256 times if it were quadratic
    assert np.frombuffer(coder.encode([b"a" * 9999])[0], np.uint32).tolist() == library().encode_ordinary("a" * 9999)


def entries(coder):
    return {r: t for t, r in coder.ranks.items()}


def test_round_trip_query(spark):
    known = library()
    got = {r.doc_id: r for r in queries.op11_rank_bpe_round_trip(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = known.encode_ordinary(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_odd_rows(spark):
    known = library()
    rows = [(i, t, "ids", b"d") for i, t in enumerate(ODD_TEXTS)] + [(0, None, "x", None), (None, "a b", "x", None), (7, "long " * 200_000, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary").repartition(3)
    out = rank_bpe.rank_round_trip(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, tuple(r.ids)) for r in out), key=key) == sorted(((i, tuple(known.encode_ordinary(t or ""))) for i, t, _, _ in rows), key=key)
    assert sorted(bytes(r.decoded) for r in out) == sorted((t or "").encode() for _, t, _, _ in rows)
    assert rank_bpe.rank_round_trip(docs.limit(0)).isEmpty()
    stored = spark.createDataFrame([(1, [72, 72]), (2, None), (3, [])], "doc_id long, ids array<int>")
    pieces = entries(rank_bpe.codec(FILE).encoder)
    assert {r.doc_id: bytes(r.decoded) for r in rank_bpe.rank_decode(stored).collect()} == {1: pieces[72] * 2, 2: b"", 3: b""}

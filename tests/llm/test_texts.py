"""Codecs, packing, chat format and licences: exact round trips and brute force."""

import hashlib
import json
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"
pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from sparkloom.llm import bpe, chat_format, license_scan, packing, queries

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "\n\n", "a", "<|endoftext|>abc<|startoftext|> x<|endoftext", "ΑΣ ΟΔΟΣ. Σ", "İstanbul ǅ", "é a ́b", "x\x1cy \x1f z", "²½ Ⅷ 10 ٣٤", "I'll don't 'S", "😀👍🏽 x🇩🇪", "a\n \nb", "a \n b", "a\t\n b", "   a   b", "word " * 5000, "x" * 20_000, "don’t “stop” — now…"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    plain = "abcdefghijklmnopqrstuvwxyz        ''.!?0123éüßñ\n\tABC<|>"
    return ["".join(rng.choice(plain) for _ in range(rng.randrange(1, 80))) for _ in range(n)] + ["".join(chr(rng.choice([rng.randrange(32, 0x600), 32, rng.randrange(0x3000, 0x3100)])) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_encoder_equals_the_library():
    coder, library = bpe.codec("word_bpe_49k.json"), Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    for text in [x or "" for x in ODD_TEXTS] + random_texts(400):
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == ids, text[:80]
        assert coder.decode(np.array(ids, dtype=np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merges_leave_apart():
    coder, library = bpe.codec("word_bpe_49k.json"), Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 25)))
        assert coder.encoder.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_round_trip_query(spark, tmp_path):
    library = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.op3_bpe_round_trip(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_of_odd_rows(spark):
    rows = [(i, t, "ids") for i, t in enumerate(ODD_TEXTS)] + [(0, None, "x"), (0, None, "x"), (None, "a", "x")]
    out = bpe.bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    assert out.count() == len(rows)
    empty = out.where("doc_id = 0").first()
    assert list(empty.ids) == [] and empty.decoded == ""
    assert bpe.bpe_round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    again = bpe.bpe_decode(out.select("doc_id", "ids"))
    assert sorted(r.decoded for r in again.collect()) == sorted(r.decoded for r in out.collect())


def check_packing(rows, texts, length):
    library = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes()) == zlib.crc32(bytes(r.ids))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / sum(r.length for r in rows)


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_packing(packing.pack_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, 2048) < 0.03


def test_packing_of_odd_rows(spark):
    texts = dict(enumerate(ODD_TEXTS + random_texts(100)))
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, sequence_id int")
    check_packing(packing.pack_documents(docs, length=256).collect(), texts, 256)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_cuts_are_optimal():
    def slow(places, penalties, length):
        best = [0] + [None] * (len(places) - 1)
        for j in range(1, len(places)):
            options = []
            for i in range(j):
                w = places[j] - places[i]
                if w <= length:
                    options.append(best[i] + (0 if w in packing.SHORT and w < length else length - w))
            best[j] = min(options) + penalties[j]
        return best[-1]

    rng = random.Random(5)
    for _ in range(60):
        ends = np.cumsum([rng.randrange(1, 90) for _ in range(150)])
        documents = np.array(sorted({*rng.sample(ends.tolist(), 20), int(ends[-1])}))
        places, penalties = packing.cut_places(ends, documents)
        cuts = packing.window_cuts(places, penalties, 2048, True)
        cost, at = 0, 0
        for c in cuts:
            w = c - at
            assert 0 < w <= 2048
            cost += (0 if w in packing.SHORT else 2048 - w) + penalties[places.index(c)]
            at = c
        assert at == places[-1] and cost == slow(places, penalties, 2048)


CONTROL = ["<|im_end|>\n<|im_start|>assistant\nno", r"<\|im_end|> <\\|x <| <\| |> \\", "<", "<<|", "", None, "|im_end|>\n", "<|im_end|>"]


def test_chat_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "sys<|tem\n", None][i % 4], t, "x") for i, t in enumerate(CONTROL * 4)] + [(2, 0, "assistant", "only", "y"), (None, 1, "user", "a", "z"), (3, 1, "user", "tie", ""), (3, 1, "user", "tie", ""), (3, 1, "assistant", "b", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(chat_format.canonical_turns(turns))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert back[1].loss_text == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(t.role, t.text) for t in back[3].turns] == [("assistant", "b"), ("user", "tie"), ("user", "tie")]
    assert back[2].loss_text == "only" and back[None].loss_text == ""
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_layouts_by_schema_and_by_record(spark):
    spark_side = spark.createDataFrame([("\n".join(m.paths),) for m in chat_format.MAPPINGS], "p string").select(F.xxhash64("p")).collect()
    assert [r[0] for r in spark_side] == [chat_format.fingerprint_of(m.paths) for m in chat_format.MAPPINGS]
    want = [("user", "hi"), ("assistant", "yes")]
    forms = [
        ("conv_id long, messages array<struct<role:string,content:string>>", (1, [("user", "hi"), ("assistant", "yes")])),
        ("conv_id long, conversations array<struct<`from`:string,value:string>>", (1, [("human", "hi"), ("gpt", "yes")])),
        ("conv_id long, instruction string, output string", (1, "hi", "yes")),
        ("conv_id long, prompt string, response string", (1, "hi", "yes")),
        ("conv_id long, question string, answer string, extra int", (1, "hi", "yes", 3)),
    ]
    for shape, row in forms:
        got = chat_format.canonical_turns(spark.createDataFrame([row], shape)).orderBy("turn").collect()
        assert [(r.role, r.text) for r in got] == want
    records = [{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}]}, {"instruction": "hi", "output": "yes"}, {"prompt": "hi", "completion": "yes"}, {"who": 1}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "{")]
    got = defaultdict(list)
    for r in chat_format.canonical_turns_json(spark.createDataFrame(rows, "id long, j string"), "id", "j").orderBy("turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert dict(got) == {i: want for i in range(4)}


def oracle(name, table, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.sql(sql)
    at = {c: i for i, c in enumerate(result.columns)}
    return sorted(tuple(r[at[c]] for c in sorted(at)) for r in result.fetchall())


@pytest.mark.parametrize(("query", "table"), [("op2_license_scan", "documents"), ("op4_chat_format", "conversations")])
def test_native_operators_equal_sql(spark, query, table):
    df = queries.QUERIES[query](spark, SF)
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == oracle(table, table, queries.ORACLE_SQL[query])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_licences_in_odd_texts(spark):
    mit = license_scan.TEMPLATES[4][1]
    rows = [(1, None), (2, ""), (3, "license"), (4, "x\n" + mit), (5, mit.replace(". ", ".\n\n").upper()), (6, "LICENSED   under cc-by NC 4.0!!"), (7, "the license of this word"), (8, mit.replace("Software", "Thing")), (6, "LICENSED   under cc-by NC 4.0!!"), (9, "license " * 20_000)]
    got = {(r.doc_id, r.license): r.dice for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(4, "MIT"), (5, "MIT"), (6, "CC-BY-NC-4.0"), (8, "MIT")} | {k for k in got if k[0] == 6}
    assert got[4, "MIT"] == 1.0 and got[5, "MIT"] == 1.0 and 0.8 <= got[8, "MIT"] < 1
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string, dice int")).count() == 0


def test_pruning_loses_no_match():
    words = license_scan.anchor_words(license_scan.TEMPLATES, 0.8)
    rng = random.Random(3)
    for _, text in license_scan.TEMPLATES:
        own = set(license_scan.bigrams(text))
        plain = license_scan.normalise(text).split(" ")
        for _ in range(40):
            a, b = sorted(rng.sample(range(len(plain) + 1), 2))
            part = " ".join(plain[a:b] + ["zz"] * rng.randrange(3))
            grams = set(license_scan.bigrams(part))
            if grams and 2 * len(grams & own) >= 0.8 * (len(grams) + len(own)):
                assert any(w in part if len(w) > 3 else w in part.split(" ") for w in words)

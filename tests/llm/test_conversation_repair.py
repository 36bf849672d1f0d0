"""Repair against a search over all lists of edits, against a plain program, and against SQL."""

import hashlib
import random
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import conversation_repair as cr
from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"
sys.setrecursionlimit(50_000)
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Of (turn, role, text) in order: blank, duplicate or truncated, the first that holds, else None."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and repaired rows by trying every edit behind every list of roles, with the rest solved first."""
    found, known = faults(rows), {}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def rest(i, q, inserted):
        key = (i, q, inserted)
        if key not in known:
            best = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
            for name in ("user", "assistant"):
                to = step.get((q, name[0]))
                if to is not None:
                    if inserted < 3:
                        best += [(c + 2, "I" + a, (f"{name}:", *o)) for c, a, o in rest(i, to, inserted + 1)]
                    if i < len(rows) and found[i] not in ("blank", "duplicate"):
                        best += [(c + 2 + (found[i] == "truncated"), "R" + a, (f"{name}:{rows[i][2]}", *o)) for c, a, o in rest(i + 1, to, 0)]
            if i < len(rows):
                best += [(c + 3, "D" + a, o) for c, a, o in rest(i + 1, q, 0)]
                to = step.get((q, rows[i][1][:1]))
                if to is not None and found[i] not in ("blank", "duplicate"):
                    best += [(c + (found[i] == "truncated"), "K" + a, (f"{rows[i][1]}:{rows[i][2]}", *o)) for c, a, o in rest(i + 1, to, 0)]
            known[key] = [min(best)] if best else []
        return known[key]

    return rest(0, 0, 0)[0]


def plain(table):
    """Results by conv_id of (conv_id, turn, role, text) rows, damaged and repaired by the rules as they are written."""
    convs = {r[0]: [] for r in table}
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return [(conv, *solved(rows)) for conv, rows in convs.items()]


def solved(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    found = faults(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, said = cheapest(rows)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def random_chats(n, seed, most=9):
    rng = random.Random(seed)
    texts = ["Good.", "so", "why?", " \n", "", "well!  \t", None, "é…", "no."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    rows = []
    for conv in range(n):
        rows += [(conv if conv else None, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"text {t}.") for t in range(rng.randrange(1, most))]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_equals_definition_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = results(queries.op12_conversation_repair(spark, SF))
    assert got == sorted(plain(rows), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op12_conversation_repair']})").fetchall(), key=repr)


@pytest.mark.parametrize("dealt", [1, 5])
def test_random_conversations(spark, dealt):
    rows = random_chats(250, 1)
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("copies", F.lit("y")).repartition(dealt)
    assert results(cr.repair_all(df)) == sorted(plain(rows), key=repr)
    assert results(cr.repair_all(df.limit(0))) == []


def test_a_conversation_over_many_tasks(spark):
    """One conversation has most rows, with copies, repeated texts and no turns in part; every task sees a piece."""
    rng = random.Random(4)
    rows = [(1, rng.choice([None, t // 2]), rng.choice(["user", "assistant", "user", "system", "x"]), rng.choice(["Same.", f"t{t}.", f"t{t}", "", "again!"])) for t in range(400)]
    rows += [(1, 7, "user", "hot.")] * 150 + random_chats(30, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert results(cr.repair_all(df)) == sorted(plain(rows), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_pieces_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cr, "PIECE_ROWS", 10)
    monkeypatch.setattr(cr, "PIECE_BYTES", 100)
    table = pa.table({"text": ["x" * n for n in [1] * 25 + [500, 60, 60, 10]]})
    assert [p.num_rows for p in cr._pieces(table)] == [10, 10, 5, 1, 1, 2]


def test_table_is_finite_and_filled_once():
    table, rng = cr.Automaton(), np.random.default_rng(1)
    kinds = rng.integers(0, cr.KINDS, 200_000)
    begins = np.unique(np.append(0, rng.integers(0, 200_000, 20_000)))
    table.scan(kinds, np.zeros(200_000, dtype=np.int64), begins, table.end())
    assert len(table.vectors) < 100
    size = len(table.vectors)
    table.scan(kinds[::-1], np.zeros(200_000, dtype=np.int64), begins, table.end())
    assert len(table.vectors) == size


def test_least_letters_win():
    for rows, want in [([(0, "tool", "x.")], (3, "D")), ([(0, "user", "x.")], (2, "KI")), ([(0, "user", "a."), (1, "user", "b.")], None), ([(0, "assistant", "b."), (1, "user", "a."), (2, "assistant", "b?")], None)]:
        cost, audit, _ = cheapest(rows)
        kinds = np.array([2 * "sua".find(r[1][0]) if r[1][0] in "sua" else 6 for r in rows])
        behind, state, offset = cr.TABLE.scan(kinds, np.zeros(len(rows), dtype=np.int64), np.array([0]), cr.TABLE.end())
        moves, last = cr.TABLE.trace(kinds, behind, np.array([0]), 0)
        assert (offset[0] + cr.TABLE.vectors[state[0]][0], "".join(cr.TABLE.moves[m][0] for m in moves) + cr.TAILS[last[0]]) == (cost, audit)
        assert want is None or want == (cost, audit)

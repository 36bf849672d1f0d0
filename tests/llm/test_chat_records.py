"""Chat records with further fields, null fields, other id columns; none is lost without a word."""

import json
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import chat_format

RECORDS = [
    ({"id": 7, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}, "messages", [("user", "hi"), ("assistant", "yes")]),
    ({"messages": [{"role": "user", "content": "hi", "name": "Ann"}, {"role": "assistant", "content": "yes"}]}, "messages", [("user", "hi"), ("assistant", "yes")]),
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes", "weight": 1}]}, "messages", [("user", "hi"), ("assistant", "yes")]),
    ({"prompt": "hi", "response": "yes", "source": "x"}, "prompt", [("user", "hi"), ("assistant", "yes")]),
    ({"instruction": None, "output": "yes"}, "instruction", [("user", ""), ("assistant", "yes")]),
    ({"prompt": "hi", "response": "yes", "system": None}, "system_prompt", [("user", "hi"), ("assistant", "yes")]),
    ({"instruction": "hi", "input": "in", "output": "yes", "extra": {"a": 1}}, "instruction_input", [("user", "hi\n\nin"), ("assistant", "yes")]),
    ({"title": "no turns"}, None, []),
    ({"messages": []}, None, []),
    ([1, 2], None, []),
    ({"data": {"prompt": "hi", "response": "yes"}}, "data.prompt", [("user", "hi"), ("assistant", "yes")]),
    ({"id": 1, "data": {"messages": [{"role": "human", "content": "hi"}], "n": {"deep": [[{"x": 1}]]}}}, "data.messages", [("user", "hi")]),
    ({"prompt": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}], "completion": [{"role": "assistant", "content": "yes"}]}, "prompt_turns", [("system", "s"), ("user", "hi"), ("assistant", "yes")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "image", "url": "u"}, {"type": "text", "text": "i"}]}, {"role": "assistant", "content": [{"type": "text", "text": None}]}]}, "message_parts", [("user", "hi"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}, "!"]}, {"role": "assistant", "content": "[{\"type\":\"text\"}]"}]}, "messages", [("user", "hi!"), ("assistant", "[{\"type\":\"text\"}]")]),
    ({"messages": [{"role": "user", "content": None}, {"role": None, "content": 5}]}, "messages", [("user", ""), ("", "5")]),
    ({"messages": ["x", {"role": "user", "content": "hi"}]}, None, []),
    ({"a": {"prompt": "hi", "response": "yes"}}, None, []),
]


def test_records_with_further_fields(spark):
    rows = [(i, json.dumps(r), "c") for i, (r, _, _) in enumerate(RECORDS)] + [(90, None, "c"), (91, "{", "c"), (None, RECORDS[3][0] and json.dumps(RECORDS[3][0]), "c")]
    records = spark.createDataFrame(rows, "id long, j string, conv_id string")
    got = defaultdict(list)
    for r in chat_format.canonical_turns_json(records, "id", "j").orderBy("turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert {i: got.get(i, []) for i in range(len(RECORDS))} == {i: want for i, (_, _, want) in enumerate(RECORDS)}
    assert got[None] == RECORDS[3][2]
    told = {r.conv_id: r.layout for r in chat_format.layouts_json(records, "id", "j").collect()}
    assert told == {i: layout for i, (_, layout, _) in enumerate(RECORDS)} | {90: None, 91: None, None: "prompt"}
    assert chat_format.layouts_json(records.limit(0), "id", "j").count() == 0


def test_rows_with_another_id_column(spark):
    rows = spark.createDataFrame([("a", 0, "user", "hi", 1.5), ("a", 1, "assistant", None, 2.5)], "thread string, turn int, role string, text string, cost double")
    got = sorted(tuple(r) for r in chat_format.canonical_turns(rows, "thread", "string").collect())
    assert got == [("a", 0, "user", "hi"), ("a", 1, "assistant", "")]
    fixed = spark.createDataFrame([(5, None, "yes"), (6, "hi", None)], "key long, instruction string, output string")
    assert sorted(tuple(r) for r in chat_format.canonical_turns(fixed, "key").collect()) == [(5, 0, "user", ""), (5, 1, "assistant", "yes"), (6, 0, "user", "hi"), (6, 1, "assistant", "")]


def paths_of(value, at=""):
    """Leaf paths by walking the parsed value."""
    if isinstance(value, dict):
        quoted = {k: k if re.fullmatch("[A-Za-z0-9_]+", k) else f"`{k}`" for k in value}
        return {p for k, v in value.items() for p in paths_of(v, f"{at}.{quoted[k]}" if at else quoted[k])}
    if isinstance(value, list):
        kinds = {type(v) for v in value if v is not None}
        if dict in kinds and len(kinds) > 1 or list in kinds and len(kinds) > 1 or not value:
            return {at + "[]"}
        below = {p for v in value if v is not None for p in paths_of(v, at + "[]")}
        return below or ({at + "[]"} if all(v is None for v in value) else set())
    return {at}


def test_paths_at_any_depth(spark):
    rng = random.Random(8)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["s", 1, 2.5, True, None, "OBJECT<a: b>"])
        if kind < 0.7:
            return {k: value(depth - 1) for k in rng.sample(["role", "content", "OBJECT", "x_1", "ä"], rng.randrange(0, 4))}
        return [[{k: "v" for k in rng.sample("abc", 2)} for _ in range(2)], ["s", "t"], [], [[1], [2, 3]], [{"p": [{"q": value(depth - 1)}]}], ["s", {"a": 1}]][rng.randrange(6)]

    values = [{"k": value(4), "l": value(3)} for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    got = {r.i: r.p for r in rows.select("i", chat_format.json_paths(F.col("j")).alias("p")).collect()}
    assert got == {i: sorted(paths_of(v)) for i, v in enumerate(values)}
    odd = spark.createDataFrame([('{"a b":1,"c.d":{"`":2}}',), ('{"a":1,"a":2}',), ("{",), (None,)], "j string")
    assert [r.p for r in odd.select(chat_format.json_paths(F.col("j")).alias("p")).collect()] == [["`a b`", "`c.d`.````"], None, None, None]


def test_nested_layouts_by_schema(spark):
    """Records of one schema give what they give as JSON, and no Python runs for either."""
    for record, layout, want in RECORDS[10:14]:
        rows = spark.createDataFrame([(3, json.dumps(record))], "key long, j string")
        typed = spark.read.json(rows.select("j").rdd.map(lambda r: r.j)).withColumn("key", F.lit(3))
        assert [(r.role, r.text) for r in chat_format.canonical_turns(typed, "key").orderBy("turn").collect()] == want, layout
        plan = chat_format.canonical_turns_json(rows, "key", "j")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    none = spark.createDataFrame([(1, None), (2, [])], "key long, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert chat_format.canonical_turns(none, "key").count() == 0

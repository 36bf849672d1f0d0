"""Rewards, sequences, tasks, rollouts, logs, code execution."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import rewards, sequences, training
from sparkloom.operators import code_exec, rollouts, tasks
from sparkloom.sources import logs


def test_rewards(spark):
    full = "<think>x</think><answer>{}</answer>".format
    rows = [("no tag 5", "5", None, 0.0, 0.0), (full(""), "5", "", 0.0, 1.0), (full("1") + full(" 2 "), "2", "2", 1.0, 1.0), ("<ANSWER>7\n</ANSWER>", "7", "7", 1.0, 0.5), (full("1,234"), "1234", "1,234", 1.0, 1.0), (full("1 1 0"), "110", "1 1 0", 1.0, 1.0), (full("-7"), "-7", "-7", 1.0, 1.0), (full("3."), "3", "3.", 1.0, 1.0), (full("1\n2"), "1", "1\n2", 1.0, 1.0), (full("4"), "four", "4", 0.0, 1.0), (full("1.000001"), "1", "1.000001", 1.0, 1.0), (None, "1", None, 0.0, 0.0)]
    out = rollouts.score_rollouts(spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i long, completion string, gold string")).orderBy("i").collect()
    for got, (_, _, answer, numeric, form) in zip(out, rows, strict=True):
        assert (got.answer, got.numeric, got.format) == (answer, numeric, form)
        assert got.reward == pytest.approx(numeric + 0.1 * form)


def test_solutions_and_code(spark):
    rows = [(0, "think\n#### 1,234"), (1, "none"), (2, "a #### -5 b #### 6")]
    got = tasks.solved_questions(spark.createDataFrame([(i, "q", a) for i, a in rows], "id long, question string, answer string")).orderBy("id").collect()
    assert [(r.thought, r.gold) for r in got] == [("think", "1234"), ("none", ""), ("a  b", "-5")]
    text = [("```python\nx = 1\n``` then ```\ny = 2\n```", "y = 2"), ("<answer> z </answer>", "z"), (" plain\n", "plain")]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in text], "t string").select(rewards.extract_code(F.col("t"))).collect()] == [b for _, b in text]


def test_supervised_pairs(spark):
    cases = [([1, 2, 3], [4, 5], 16), ([1], [2], 16), ([1, 2, 3], [4], 3), ([1, 2], [3, 4, 5], 4), ([], [], 16)]
    for prompt, target, block in cases:
        df = spark.createDataFrame([(prompt, target)], "p array<int>, t array<int>")
        x, y, usable = sequences.supervised_pair(F.col("p"), F.col("t"), 0, block)
        r = df.select(x.alias("x"), y.alias("y"), usable.alias("u")).first()
        full = (prompt + target + [0])[:block]
        assert r.u == (len(full) >= 2 and len(prompt) < len(full))
        if r.u:
            want = [-1 if i < len(prompt) - 1 else v for i, v in enumerate(full[1:])]
            assert (r.x, r.y) == (full[:-1], want)


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([5, 0, 7, 0, 9], 2), ([5, 6], 1), ([5, 6], 2)], "ids array<int>, p int")
    end = sequences.first_end(F.col("ids"), F.col("p"), 0)
    out = df.select(end.alias("e"), sequences.completion_mask(F.col("ids"), F.col("p"), end).alias("m"), sequences.pad(F.col("ids"), F.lit(6), -1).alias("x")).collect()
    assert [(r.e, r.m) for r in out] == [(4, [0, 0, 1, 1, 0]), (2, [0, 1]), (2, [0, 0])]
    assert out[1].x == [5, 6, -1, -1, -1, -1]


def test_advantages(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (2, 5.0), (3, 1.0)], "g long, reward double")
    got = sorted((r.g, round(r.advantage, 3)) for r in rollouts.group_advantage(df, ["g"]).collect())
    assert got == [(1, -1.0), (1, 1.0), (2, 0.0), (2, 0.0), (3, 0.0)]


def test_tasks(spark):
    rows = tasks.preset(spark, "arithmetic_hard", 500, 1).collect()
    for r in rows:
        assert str(eval(r.question.removeprefix("What is ").removesuffix("?"))) == r.gold and int(r.gold) >= 0  # noqa: S307
        assert r.answer == " ".join(r.gold)
    train, test = tasks.preset(spark, "arithmetic", 500, 0), tasks.preset(spark, "arithmetic", 300, 9)
    left = {r.question for r in tasks.held_out(test, train).collect()}
    assert left and not left & {r.question for r in train.collect()}


@pytest.mark.parametrize("n", [12, 13])
def test_batches(spark, n):
    rows = spark.range(n)
    got = tasks.batches(rows, 4, 1, 0).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in got) == sorted([4] * (n // 4) + [n % 4] * (n % 4 > 0))
    assert tasks.batches(rows, 4, 1, 0, drop_last=True).count() == (8 if n == 12 else 12)
    assert tasks.sample_prompts(rows, 5, 0, 3).distinct().count() == 5


def test_sampling(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([3.0, 2.0, 2.0, 1.0])], "g long, token long, score double")
    assert {r.token for r in rollouts.top_k(rows, ["g"], "score", 2).collect()} == {0, 1, 2}
    shares = rollouts.softmax_shares(rows, ["g"], "score")
    assert sum(r.share for r in shares.collect()) == pytest.approx(1)
    assert rollouts.multinomial(shares, ["g"], 4).first().token in range(4)


def test_schedule_and_numbers(spark):
    lr = [r[0] for r in spark.range(12).select(training.learning_rate(F.col("id"), 4, 10, 1.0, 0.1)).collect()]
    assert lr[:4] == [0.25, 0.5, 0.75, 1.0] and lr[4] == 1.0 and lr[10:] == [0.1, 0.1] and lr[7] == pytest.approx(0.55)
    row = spark.range(1).select(training.clipped_policy_loss(F.lit(2.0), F.lit(1.0)).alias("a"), training.kl_estimate(F.lit(0.5), F.lit(0.0)).alias("k")).first()
    assert row.a == pytest.approx(-1.2) and row.k == pytest.approx(math.exp(0.5) - 1.5)


def test_logs(spark):
    lines = spark.createDataFrame([("step 10 | loss 2.5 | lr 1e-4",), ("  step 20 val_loss 3.25",), ("step 3 reward 0.7 acc 0.5 kl 1",), ("other",)], "value string")
    assert [tuple(r) for r in logs.parse_log(lines, "loss").collect()] == [(10, 2.5)]
    assert [tuple(r) for r in logs.parse_log(lines, "val").collect()] == [(20, 3.25)]
    assert [tuple(r) for r in logs.parse_log(lines, "reward").collect()] == [(3, 0.7, 0.5)]


def test_code_execution(spark):
    code = "```python\ndef add(a, b):\n    return a + b\n```"
    rows = spark.createDataFrame([(1, code, ["assert add(1, 2) == 3"]), (2, code, ["assert add(1, 2) == 3", "assert add(1, 1) == 3"]), (3, code, [])], "id long, completion string, tests array<string>")
    with pytest.raises(PermissionError):
        code_exec.code_rewards(rows)
    assert {r.id: r.pass_rate for r in code_exec.code_rewards(rows, allow_untrusted=True).collect()} == {1: 1.0, 2: 0.5, 3: 0.0}
    assert not code_exec.run_group("while True: pass", "", timeout=0.5)

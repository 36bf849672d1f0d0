"""Task tables for post-training: arithmetic examples, question answering, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.rewards import final_answer, reasoning

#: Presets: largest operand and operations.
PRESETS = {"arithmetic": (99, "+"), "arithmetic_hard": (999, "+-")}


def draw(index: Column, seed: int, stream: int, n: int) -> Column:
    """A number below n from two rounds of a linear congruence and a product of the parts: plain arithmetic, the same in
    every engine."""
    x = (index * F.lit(48_271) + F.lit(seed * 7919 + stream * 104_729 + 12_345)) % F.lit(2_147_483_647)
    x = (x * F.lit(69_621) + F.lit(stream + 1)) % F.lit(2_147_483_647)
    x = ((x % F.lit(46_337)) * F.floor(x / F.lit(46_337)) + x) % F.lit(2_147_483_647)
    return F.floor(x / F.lit(7)) % F.lit(n)


def arithmetic_examples(spark: SparkSession, n: int, seed: int = 0, max_value: int = 99, operations: str = "+") -> DataFrame:
    """``id, question, thought, answer, gold``; operands are swapped where a difference would be negative."""
    i = F.col("id")
    a, b = draw(i, seed, 1, max_value - 1) + 2, draw(i, seed, 2, max_value - 1) + 2
    op = F.substring(F.lit(operations), (draw(i, seed, 3, len(operations)) + 1).cast("int"), F.lit(1))
    rows = spark.range(n).select("id", a.alias("a0"), b.alias("b0"), op.alias("op"))
    swap = (F.col("op") == "-") & (F.col("a0") < F.col("b0"))
    rows = rows.select("id", "op", F.when(swap, F.col("b0")).otherwise(F.col("a0")).alias("a"), F.when(swap, F.col("a0")).otherwise(F.col("b0")).alias("b"))
    value = F.when(F.col("op") == "+", F.col("a") + F.col("b")).when(F.col("op") == "-", F.col("a") - F.col("b")).otherwise(F.col("a") * F.col("b"))
    shown = F.concat(t.spaced_digits(F.col("a")), F.lit(" "), F.col("op"), F.lit(" "), t.spaced_digits(F.col("b")), F.lit(" = "), t.spaced_digits(value))
    question = F.concat(F.lit("What is "), F.col("a").cast("string"), F.lit(" "), F.col("op"), F.lit(" "), F.col("b").cast("string"), F.lit("?"))
    return rows.select("id", question.alias("question"), shown.alias("thought"), t.spaced_digits(value).alias("answer"), value.cast("string").alias("gold"))


def preset(spark: SparkSession, name: str, n: int, seed: int = 0) -> DataFrame:
    largest, operations = PRESETS[name]
    return arithmetic_examples(spark, n, seed, largest, operations)


def supervised(examples: DataFrame) -> DataFrame:
    return examples.select("id", t.prompt_text(F.col("question")).alias("prompt"), t.target_text(F.col("thought"), F.col("answer")).alias("target"))


def reinforcement(examples: DataFrame) -> DataFrame:
    return examples.select("id", t.prompt_text(F.col("question")).alias("prompt"), "gold")


def solved_questions(rows: DataFrame, n: int | None = None, order_col: str = "id") -> DataFrame:
    """Question-answer rows with worked solutions, split into thought and final answer; the first n if given."""
    rows = rows.orderBy(order_col).limit(n) if n else rows
    return rows.select(order_col, "question", reasoning(F.col("answer")).alias("thought"), final_answer(F.col("answer")).alias("gold"))


def held_out(evaluation: DataFrame, training: DataFrame, key: str = "question") -> DataFrame:
    """Evaluation rows that training has no copy of."""
    return evaluation.join(training.select(key).distinct(), key, "left_anti")


def batches(rows: DataFrame, size: int, seed: int, epoch: int, id_col: str = "id", drop_last: bool = False) -> DataFrame:
    """Adds a batch number after a seeded shuffle. Buckets of the shuffle hash are numbered in two levels, so no task
    orders all rows. ``drop_last`` leaves out the last batch, full or not, as some loops do."""
    shuffled = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(id_col))).withColumn("_b", F.shiftrightunsigned("_h", 52))
    counts = shuffled.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))  # 4096 rows
    placed = shuffled.join(starts, "_b").withColumn("_r", F.col("_s") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)) - 1)
    out = placed.withColumn("batch", F.floor(F.col("_r") / size)).drop("_h", "_b", "_s", "_r")
    if drop_last:
        last = out.agg(F.max("batch").alias("l"))
        out = out.join(last, F.col("batch") < F.col("l")).drop("l")
    return out


def sample_prompts(rows: DataFrame, k: int, seed: int, step: int, id_col: str = "id") -> DataFrame:
    """k rows without replacement, another draw for each step."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.lit(step), F.col(id_col)), id_col).limit(k)

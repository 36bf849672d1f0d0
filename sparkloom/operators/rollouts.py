"""Scoring of rollouts, evaluation metrics, sampling over given scores, the last user message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rewards as r

EPSILON = 1e-4


def score_rollouts(rows: DataFrame, format_weight: float = 0.1) -> DataFrame:
    c, g = F.col("completion"), F.col("gold")
    return rows.withColumn("answer", r.extract_answer(c)).withColumn("numeric", r.numeric_reward(c, g)).withColumn("format", r.format_reward(c)).withColumn("reward", F.col("numeric") + F.lit(format_weight) * F.col("format"))


def group_advantage(rows: DataFrame, keys: list[str], reward_col: str = "reward", epsilon: float = EPSILON) -> DataFrame:
    """(reward - mean) / (population deviation + epsilon) within each group of rollouts.

    Group statistics come from an aggregation that combines before the shuffle and are joined back, so a group with a
    large share of all rows is split by adaptive execution instead of filling one window task."""
    stats = rows.groupBy(*keys).agg(F.avg(reward_col).alias("mean"), F.stddev_pop(reward_col).alias("std"))
    return rows.join(stats, keys).withColumn("advantage", (F.col(reward_col) - F.col("mean")) / (F.col("std") + F.lit(epsilon)))


def batch_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("reward").alias("mean_reward"), F.avg("numeric").alias("accuracy"))


def evaluation(rows: DataFrame) -> DataFrame:
    """Accuracy and share of well-formed completions, in per cent."""
    return rows.agg(F.count("*").alias("n"), (F.avg("numeric") * 100).alias("accuracy"), (F.avg((F.col("format") >= 1.0).cast("int")) * 100).alias("format_rate"))


def masked_mean(value: Column, mask: Column) -> Column:
    return F.sum(value * mask) / F.greatest(F.sum(mask), F.lit(1.0))


def top_k(rows: DataFrame, keys: list[str], score_col: str, k: int) -> DataFrame:
    """Rows with a score of at least the k-th best of their group; ties at the edge stay."""
    best = Window.partitionBy(*keys).orderBy(F.desc(score_col))
    return rows.withColumn("_rank", F.rank().over(best)).where(F.col("_rank") <= k).drop("_rank")


def softmax_shares(rows: DataFrame, keys: list[str], score_col: str, temperature: float = 1.0) -> DataFrame:
    """Shares of the softmax of scores over a temperature, safe for large scores."""
    high = rows.groupBy(*keys).agg(F.max(score_col).alias("_high"))
    raised = rows.join(high, keys).withColumn("_e", F.exp((F.col(score_col) - F.col("_high")) / F.lit(temperature)))
    total = raised.groupBy(*keys).agg(F.sum("_e").alias("_t"))
    return raised.join(total, keys).withColumn("share", F.col("_e") / F.col("_t")).drop("_high", "_e", "_t")


def multinomial(rows: DataFrame, keys: list[str], seed: int, share_col: str = "share", id_col: str = "token") -> DataFrame:
    """One draw a group in proportion to the shares: the largest log(u) / share, with u hashed from seed and row."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys, id_col), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    drawn = rows.where(F.col(share_col) > 0).withColumn("_g", F.log(u) / F.col(share_col))
    return drawn.groupBy(*keys).agg(F.max_by(id_col, "_g").alias(id_col))


def last_user_message(conversations: DataFrame) -> DataFrame:
    """Text of the last user turn of each conversation; empty without one."""
    user = F.col("role") == "user"
    last = F.max_by(F.when(user, F.coalesce("text", F.lit(""))), F.when(user, F.col("turn")))
    return conversations.groupBy("conv_id").agg(F.coalesce(last, F.lit("")).alias("message"))


def evaluation_loss(rows: DataFrame, keys: list[str], batch_col: str, loss_col: str = "loss", batches: int = 20) -> DataFrame:
    """Mean loss over the first batches of each evaluation. Map tasks keep no more than these."""
    first = Window.partitionBy(*keys).orderBy(batch_col)
    kept = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= batches)
    return kept.groupBy(*keys).agg(F.avg(loss_col).alias("val_loss"), F.count("*").alias("n_batches"))

"""Numbers of training runs: schedules, throughput, policy terms, parameter counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(step: Column, warmup: int, total: int, highest: float, lowest: float) -> Column:
    """Linear warm-up, then a cosine down to the lowest rate, which stays."""
    share = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, F.lit(highest) * (step + 1) / F.lit(float(warmup))).when(step >= total, F.lit(lowest)).otherwise(F.lit(lowest) + F.lit(0.5 * (highest - lowest)) * (F.lit(1.0) + F.cos(F.lit(math.pi) * share)))


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.try_divide(tokens, seconds)


def model_flops_utilisation(parameters: Column, tokens: Column, seconds: Column, peak: float = 312e12) -> Column:
    return F.try_divide(F.lit(6.0) * parameters * tokens, seconds * F.lit(peak))


def parameter_estimate(vocabulary: Column, layers: Column, width: Column) -> Column:
    """Embedding and twelve squares of the width a layer."""
    return vocabulary * width + layers * F.lit(12) * width * width


def clipped_policy_loss(ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    return -F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)


def kl_estimate(log_reference: Column, log_policy: Column) -> Column:
    """exp(d) - d - 1 with d the difference of log-probabilities."""
    d = log_reference - log_policy
    return F.exp(d) - d - 1


def token_log_prob(logits: Column, index: Column) -> Column:
    """Log of the softmax of an array of logits at an index from 0; safe for large logits, null outside the array."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    return F.get(logits, index) - top - F.log(total)

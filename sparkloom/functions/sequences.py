"""Token sequences of supervised and reinforcement examples, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -1


def supervised_pair(prompt: Column, target: Column, end_id: int, block: int) -> tuple[Column, Column, Column]:
    """x, y and whether the example is usable: prompt, target and end, cut to the block; prompt labels are masked."""
    full = F.slice(F.concat(prompt, target, F.array(F.lit(end_id))), 1, block)
    usable = (F.size(full) >= 2) & (F.size(prompt) < F.size(full))
    n = F.greatest(F.size(full) - 1, F.lit(0))
    y = F.transform(F.slice(full, 2, n), lambda v, i: F.when(i < F.size(prompt) - 1, F.lit(IGNORED)).otherwise(v))
    return F.slice(full, 1, n), y, usable


def pad(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value).cast("int"), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def first_end(ids: Column, prompt_length: Column, end_id: int) -> Column:
    """Index past the first end token at or behind the prompt; the length without one."""
    at = F.array_position(F.slice(ids, prompt_length + 1, F.greatest(F.size(ids) - prompt_length, F.lit(0))), F.lit(end_id))
    return F.when(at > 0, prompt_length + at).otherwise(F.size(ids)).cast("int")


def completion_mask(ids: Column, prompt_length: Column, end: Column) -> Column:
    return F.transform(ids, lambda _, i: F.when((i >= prompt_length) & (i < end), 1).otherwise(0))


def pad_id_or_end(pad_id: Column, end_id: Column) -> Column:
    return F.coalesce(pad_id, end_id)


def rollout_row(ids: Column, mask: Column, length: Column, pad_id: int) -> tuple[Column, Column, Column]:
    """x, y and the mask of y for a rollout padded to a length: y are the ids after each of x, padding is masked."""
    full, marks = pad(ids, length, pad_id), pad(mask, length, 0)
    n = F.greatest(F.size(full) - 1, F.lit(0))
    return F.slice(full, 1, n), F.slice(full, 2, n), F.slice(marks, 2, n)

"""Epochs whose batches are read by themselves: a keyed permutation of row numbers, so nothing is shuffled or stored.

A row number x < n is a pair (x div b, x mod b) with sides a = ceil(root of n) and b = ceil(n / a). Feistel rounds add a
keyed function of one half to the other, which permutes the a * b pairs; numbers from n on are walked past by applying the
rounds again. Fewer than a pairs lie there, so the longest walk of a key is known before any row is read."""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME, ROUNDS = (1 << 31) - 1, 6
#: Row numbers stay exact as doubles.
MOST_ROWS = 1 << 53


def round_keys(seed: int, epoch: int) -> list[tuple[int, int]]:
    """Two numbers below PRIME for each round, from MD5 of seed, epoch and round."""
    digests = [hashlib.md5(f"{seed}:{epoch}:{i}".encode()).digest() for i in range(ROUNDS)]
    return [(int.from_bytes(d[:8], "big") % PRIME, int.from_bytes(d[8:], "big") % PRIME) for d in digests]


def sides(n: int) -> tuple[int, int]:
    if not 0 < n <= MOST_ROWS:
        raise ValueError(f"an epoch has 1 to {MOST_ROWS} rows, not {n}")
    a = isqrt(n - 1) + 1
    return a, -(-n // a)


def _mix(v, k1, k2):
    """The round function, of arrays as of columns; squares of numbers below PRIME fit into 62 bits."""
    v = (v + k1) % PRIME
    v = (v * v + k2) % PRIME
    return (v * v + k1) % PRIME


def _rounds(x: np.ndarray, n: int, keys: list[tuple[int, int]], back: bool = False) -> np.ndarray:
    a, b = sides(n)
    left, right = x // b, x % b
    for i in range(ROUNDS)[:: -1 if back else 1]:
        if i % 2 == 0:
            moved = _mix(right, *keys[i])
            left = (left - moved if back else left + moved) % a
        else:
            moved = _mix(left, *keys[i])
            right = (right - moved if back else right + moved) % b
    return left * b + right


def row_at(places: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """Numbers of the rows at these places of the epoch."""
    keys = round_keys(seed, epoch)
    x = _rounds(np.asarray(places, dtype=np.int64), n, keys)
    while (over := np.flatnonzero(x >= n)).size:
        x[over] = _rounds(x[over], n, keys)
    return x


def longest_walk(n: int, seed: int, epoch: int) -> int:
    """How often the rounds must be repeated at most, in either direction: the longest run of numbers from n on."""
    a, b = sides(n)
    keys = round_keys(seed, epoch)
    over = np.arange(n, a * b, dtype=np.int64)
    over = over[_rounds(over, n, keys, back=True) < n]  # where walks enter; cycles outside are entered by none
    steps = 0
    while over.size:
        steps += 1
        over = _rounds(over, n, keys)
        over = over[over >= n]
    return steps


def place_of(row: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of a row number in the epoch, 0 to n - 1; null for numbers outside 0 to n - 1."""
    a, b = sides(n)
    keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(k1).alias("k1"), F.lit(k2).alias("k2")) for i, (k1, k2) in reversed(list(enumerate(round_keys(seed, epoch))))])

    def undo(halves: Column, k: Column) -> Column:
        left, right = halves["l"], halves["r"]
        moved_left = F.pmod(left - _mix(right, k["k1"], k["k2"]), F.lit(a))
        moved_right = F.pmod(right - _mix(left, k["k1"], k["k2"]), F.lit(b))
        return F.struct(F.when(k["even"], moved_left).otherwise(left).alias("l"), F.when(k["even"], right).otherwise(moved_right).alias("r"))

    def back(x: Column) -> Column:
        halves = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, halves, undo, lambda h: h["l"] * b + h["r"])

    x = F.when(row.between(0, n - 1), row.cast("long"))
    walks = F.array_repeat(F.lit(0), longest_walk(n, seed, epoch) + 1)
    # The first step is taken by all, any further one by what is still outside.
    start = F.struct(x.alias("x"), F.lit(True).alias("go"))
    step = lambda s, _: F.struct(F.when(s["go"] | (s["x"] >= n), back(s["x"])).otherwise(s["x"]).alias("x"), F.lit(False).alias("go"))
    return F.aggregate(walks, start, step, lambda s: s["x"])


def epoch_places(rows: DataFrame, n: int, size: int, seed: int, epoch: int, index_col: str = "idx") -> DataFrame:
    """Adds ``place`` and ``batch`` of the epoch to rows numbered 0 to n - 1; no shuffle. All batches but the last are full."""
    placed = rows.withColumn("place", place_of(F.col(index_col), n, seed, epoch))
    return placed.withColumn("batch", ((F.col("place") - F.col("place") % size) / size).cast("long"))


def read_batch(rows: DataFrame, n: int, size: int, batch: int, seed: int, epoch: int, index_col: str = "idx") -> DataFrame:
    """The rows of one batch with their ``place``, found by their numbers: a filter that the scan gets, no pass over the epoch.
    A batch beyond the last has no rows."""
    places = np.arange(batch * size, min((batch + 1) * size, n), dtype=np.int64)
    if not places.size:
        return rows.limit(0).withColumn("place", F.lit(None).cast("long"))
    numbers = row_at(places, n, seed, epoch).tolist()
    at = F.array_position(F.array(*map(F.lit, numbers)), F.col(index_col).cast("long")) - 1 + int(places[0])
    return rows.where(F.col(index_col).isin(numbers)).withColumn("place", at)

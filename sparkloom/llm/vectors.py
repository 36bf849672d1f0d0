"""What the two embedding operators share: usable vectors, arrays out of Arrow, k-means, a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_length(rows: DataFrame, column: str = "v") -> tuple[int, int]:
    """The commonest vector length (ties: the smaller) and how many rows have it; zeros without rows."""
    top = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return (top[0]["d"], top[0]["count"]) if top else (0, 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safely for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bounded_sample(rows: DataFrame, limit: int, dim: int, id_col: str = "id", column: str = "v") -> np.ndarray:
    """Unit vectors of at most ``limit`` rows, those whose id hashes lowest."""
    top = rows.orderBy(F.xxhash64(F.lit(17), id_col), id_col, column).limit(limit).select(column).collect()
    return unit(np.array([r[0] for r in top], dtype=np.float64).reshape(-1, dim)) if top else np.zeros((0, dim))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres**2).sum(axis=1)[None, :]
    return np.concatenate([(square - 2 * x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; an empty cluster restarts at a random row."""
    if not len(x):
        return np.zeros((k, x.shape[1]))
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        order = np.argsort(near, kind="stable")
        filled, begin, count = np.unique(near[order], return_index=True, return_counts=True)
        centres[filled] = np.add.reduceat(x[order], begin, axis=0) / count[:, None]
        empty = np.setdiff1d(np.arange(k), filled)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres

"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation with map-side combine and an equi-join; nothing is collected to the driver, and each round
ends in a table of the shared folder. The edges of a node with a large share of them all are salted. Tables of at most
``FEW_EDGES`` contracted edges need no rounds: a round is some twenty jobs, whose plans cost the driver more than that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, salted_join

_EDGE = "u long, v long"
#: Contracted edges that one task takes at once (16 bytes each); larger tables go by rounds.
FEW_EDGES = 1 << 20


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node of each one's component."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return nodes, nodes[label]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of each batch as stars; a batch, not a partition, so memory has a bound."""
    for pdf in batches:
        nodes, roots = union_find(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        far = nodes != roots
        yield pd.DataFrame({"u": nodes[far], "v": roots[far]})


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every node and its component, of at most ``FEW_EDGES`` edges."""
    several = list(batches)
    if several:
        nodes, roots = union_find(*(np.concatenate([pdf[c].to_numpy() for pdf in several]) for c in "uv"))
        yield pd.DataFrame({"node": nodes, "component": roots})


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return salted_join(both.where("v > u"), low, ["u"], total, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges point from the larger node to a smaller one."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = salted_join(edges, low, ["u"], total, "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node with an edge to another; component is its smallest node.

    Null ends, loops and repeated edges are ignored. An empty table gives an empty table."""
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(pairs.mapInPandas(_contract, _EDGE))
    if now.count() <= FEW_EDGES:
        out = materialize(now.coalesce(1).mapInPandas(_finish, "node long, component long"))
        drop_table(now)
        return out
    mark = None
    while True:
        # In a finished forest of stars no centre is itself a leaf, and every leaf has one centre.
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == mark or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = state
        after = materialize(_small_star(_large_star(now, state["n"]), state["n"]))
        drop_table(now)
        now = after

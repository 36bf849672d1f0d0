"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, one for each half of the (unit) vector, span a product grid of cells. Every vector is stored in its home
cell. It visits further cells in the order of a multi-sequence traversal: cell (i, j) costs h_i^2 + h_j^2, where h is the
distance from the vector's half to the bisector between its own centroid and another one - the least a duplicate must
have moved to fall there. Traversal stops where the cost exceeds the radius within which ``TARGET_RECALL`` of duplicates
lie: a duplicate lies at most ``sqrt(2 - 2 cos)`` away, and in a given direction within z times that over the root of the
dimension. All vectors that meet in a cell are verified in double precision.

Equal vectors are collapsed first. A task holds a block of a cell's residents and a block of its visitors, so a hot cell
is many tasks; links are counted and contracted there and never leave as pairs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, salted_join
from .graph import connected_components
from .vectors import bounded_sample, kmeans, matrix, unit, usable, usual_length

TARGET_RECALL = 0.9999
#: Words of a half: the root of the rows of a label over CELL_ROWS, so that cells stay as full at any size. Up to
#: MOST_WORDS^2 * CELL_ROWS (half a billion) rows a label; beyond that cells fill, and are dealt out to more blocks.
SAMPLE, CELL_ROWS, LEAST_WORDS, MOST_WORDS = 16_384, 128, 4, 2048
BLOCK = 2048


class MultiIndex:
    def __init__(self, left: np.ndarray, right: np.ndarray, threshold: float, recall: float):
        self.books = (left, right)
        self.cut = left.shape[1]
        self.apart = [np.sqrt(np.maximum((b**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * b @ b.T, 1e-24)) for b in self.books]
        dim = left.shape[1] + right.shape[1]
        far = np.sqrt(max(0.0, 2 - 2 * threshold))
        self.radius2 = min(far, NormalDist().inv_cdf(1 - (1 - recall) / 2) * far / np.sqrt(dim)) ** 2 + 1e-12

    def margins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Home word in each half, and squared distances to the bisectors towards all words."""
        homes, out = [], []
        for half, book, apart in ((x[:, : self.cut], self.books[0], self.apart[0]), (x[:, self.cut :], self.books[1], self.apart[1])):
            # einsum: a row's margins must not depend on the batch it is in, as a product of matrices would let them.
            d = (book**2).sum(axis=1)[None, :] - 2 * np.einsum("id,kd->ik", half, book)
            home = d.argmin(axis=1)
            homes.append(home)
            out.append(((d - d[np.arange(len(d)), home][:, None]) / (2 * apart[home])) ** 2)
        return homes, out

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Cells of one vector in multi-sequence order, nearest first, up to the radius."""
        i, j = (near[np.argsort(m[near], kind="stable")] for m, near in ((a, np.flatnonzero(a <= self.radius2)), (b, np.flatnonzero(b <= self.radius2))))
        out, heap, seen = [], [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}
        while heap:
            cost, r, s = heapq.heappop(heap)
            if cost > self.radius2:
                break
            out.append((int(i[r]), int(j[s])))
            for r2, s2 in ((r + 1, s), (r, s + 1)):
                if r2 < len(i) and s2 < len(j) and (r2, s2) not in seen:
                    seen.add((r2, s2))
                    heapq.heappush(heap, (a[i[r2]] + b[j[s2]], r2, s2))
        return out


_VISIT = "label string, cell long, home boolean, own long, id long, c long, v binary"


def _deal(batches: Iterator[pa.RecordBatch], index, dim: int, kind: str) -> Iterator[pa.RecordBatch]:
    """A row for each cell that a vector visits, with the vector as it is in the table."""
    index = index.value
    words = len(index.books[1])
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = matrix(batch.column(1), dim)
        (h1, h2), (m1, m2) = index.margins(unit(raw))
        rows, cells, own = [], [], []
        for r in range(len(raw)):
            home = int(h1[r]) * words + int(h2[r])
            found = {i * words + j for i, j in index.visits(m1[r], m2[r])} | {home}
            rows += [r] * len(found)
            cells += sorted(found)
            own += [home] * len(found)
        take = pa.array(rows, pa.int64())
        vectors = pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(3).take(take), pa.array(cells, pa.int64()), pa.array([c == o for c, o in zip(cells, own, strict=True)], pa.bool_()), pa.array(own, pa.int64()), batch.column(0).take(take), batch.column(2).take(take), vectors.take(take)], names=["label", "cell", "home", "own", "id", "c", "v"])


def _contract(linked: np.ndarray, p: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable within the block, for the rows and the columns of a link matrix."""
    nodes, at = np.unique(np.concatenate([p, h]), return_inverse=True)
    ip, ih = at[: len(p)], at[len(p) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        for m, a, b in ((linked, ip, ih), (linked.T, ih, ip)):
            order = np.argsort(label[b], kind="stable")
            sorted_ = m[:, order]
            some = sorted_.any(axis=1)
            low = label[b][order][sorted_.argmax(axis=1)]
            np.minimum.at(label, a[some], low[some])
        label = label[label]
        if (label == before).all():
            return nodes[label[ip]], nodes[label[ih]]


def _verify(pdf: pd.DataFrame, index, threshold: float, kind: str) -> pd.DataFrame:
    """Link counts and contracted links among the residents and visitors of one block of a cell."""
    index = index.value
    home, seen = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    nothing = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    if not len(home) or not len(seen):
        return nothing
    x, y = (unit(np.frombuffer(b"".join(side["v"]), dtype=kind).astype(np.float64).reshape(len(side), -1)) for side in (seen, home))
    p, h = seen["id"].to_numpy(np.int64), home["id"].to_numpy(np.int64)
    weight_p, weight_h = seen["c"].to_numpy(np.int64), home["c"].to_numpy(np.int64)
    linked = (x @ y.T >= threshold) & (p[:, None] != h[None, :])
    if not linked.any():
        return nothing
    add_p = linked @ weight_h
    # A visitor's link is seen again from the other side where the resident visits the visitor's home; if it doesn't,
    # it counts for the resident here.
    own, where = np.unique(seen["own"].to_numpy(np.int64), return_inverse=True)
    _, (m1, m2) = index.margins(y)
    words = len(index.books[1])
    homes = home["own"].to_numpy(np.int64)
    back = (m1[:, own // words] + m2[:, own % words] <= index.radius2) | (homes[:, None] == own[None, :])
    add_h = weight_p @ (linked & ~back[:, where].T)
    root_p, root_h = _contract(linked, p, h)
    out = pd.DataFrame({"id": np.concatenate([p, h]), "links": np.concatenate([add_p, add_h]), "root": np.concatenate([root_p, root_h])})
    return out[(out["links"] > 0) | (out["root"] != out["id"])]


def near_duplicates(rows: DataFrame, threshold: float = 0.98, recall: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each input row: id, ``n_links`` (other vectors of cosine >= threshold and equal label),
    ``component_id`` (smallest id reachable by links) and ``kept`` (whether that is its own).

    Vectors that are null, zero or hold null or non-finite components, and rows of null label or id, link with nothing;
    nor do vectors of another length than the commonest. Repeated rows of one id and vector count once; other columns
    are not read.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    valid = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    dim, _ = usual_length(valid)
    valid = valid.where(F.size("v") == dim)
    # 128 bits stand for a vector wherever rows meet by it (adding 0.0 makes one zero of the two).
    plain = F.transform("v", lambda x: x + F.lit(0).cast(valid.schema["v"].dataType.elementType))
    key = [F.xxhash64(plain).alias("h"), F.xxhash64(F.lit(29), plain).alias("g")]
    distinct = materialize(valid.groupBy("label", "v").agg(F.min("id").alias("id"), F.count_distinct("id").alias("c")).select("id", "v", "c", "label"))
    sizes = distinct.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("l")).first()
    cut = max(1, dim // 2)
    sample = bounded_sample(distinct, SAMPLE, max(dim, 2))
    words = int(np.clip(np.ceil(np.sqrt(sizes["n"] / max(1, sizes["l"]) / CELL_ROWS)), LEAST_WORDS, MOST_WORDS))
    rng = np.random.default_rng(2)
    index = spark.sparkContext.broadcast(MultiIndex(kmeans(sample[:, :cut], words, 10, rng), kmeans(sample[:, cut:], words, 10, rng), threshold, recall))  # MOST_WORDS x dim floats at most
    # Single precision where the table has no more: half the bytes in every shuffle, and the same doubles after it.
    kind = "<f4" if distinct.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    met = distinct.mapInArrow(partial(_deal, index=index, dim=dim, kind=kind), _VISIT)
    met = materialize(met)
    cells = met.groupBy("label", "cell").agg(F.count_if("home").alias("residents"), F.count("*").alias("visitors")).where((F.col("residents") > 0) & (F.col("visitors") > 1))
    cells = cells.select("label", "cell", F.ceil(F.col("residents") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("pb"), F.col("visitors").alias("n"))
    dealt = salted_join(met, cells, ["label", "cell"], met.count(), "id")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = dealt.where("home").select("label", "cell", part("hb").alias("x"), all_("pb").alias("y"), F.lit(0).alias("side"), "own", "id", "c", "v")
    visitors = dealt.select("label", "cell", all_("hb").alias("x"), part("pb").alias("y"), F.lit(1).alias("side"), "own", "id", "c", "v")
    # Dealt out by block: the join's own partitioning, by cell, would satisfy the grouping and put a hot cell in one task.
    blocks = residents.unionByName(visitors).repartition("label", "cell", "x", "y").groupBy("label", "cell", "x", "y")
    found = materialize(blocks.applyInPandas(lambda pdf: _verify(pdf, index, threshold, kind), "id long, links long, root long"))
    drop_table(met)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "id", "root")
    # Merge joins: what links has no proven bound.
    known = distinct.select("id", "c", "label", *key).join(links.hint("merge"), "id", "left").join(parts.hint("merge"), F.col("id") == F.col("node"), "left")
    known = known.select("label", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")).where("n_links > 0")
    marked = base.select("id", F.when(F.col("id").isNotNull() & usable(F.col("v")), F.col("label")).alias("label"), *key)
    out = marked.join(known.hint("merge"), ["label", "h", "g"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by a sum of one codeword from each of ``BOOKS`` full-dimensional codebooks. The codebooks
are learned on a bounded sample: k-means on residuals, then rounds of beam-search encoding and least squares over all
books together. Every row is encoded by beam search; with its codes go the norm of the approximation and the length of
the residual. A query makes a table of its products with all codewords; the estimate of a cosine is a sum of table
entries over the stored norm.

Rows are dealt out to the cells of a coarse codebook, and large cells to blocks by hash. A row is sent to its one block; a
query is sent to the blocks of its nearest cells. Blocks grow with the table, so there are no more than ``MOST_CELLS`` +
``MOST_BLOCKS`` of them, and a query has no more copies, until a block has ``BLOCK_BYTES`` of vectors. How many cells that are is measured on the sample: as many as hold
``PROBE_RECALL`` of true neighbours there (where neighbours are no nearer than in the whole table), and all that are about
as near as the nearest one: a query unlike the sample lies between many cells, whatever the sample needs.

A task takes in the rows of a block and lets the queries stream by. The rows are scored ``TILE`` at a time. For each query
the best estimates of the tile are reranked exactly. All other rows whose estimate is within ``MARGIN`` standard errors of the neighbour that would be
displaced, among all tiles so far, are reranked as well: the error of an estimate is the query's share of the residual, about its length over the
root of the dimension, if the two are independent. In clusters that the sample doesn't hold they are not: row and query
lack the same. So the errors of a query's k nearest rows so far, by ``SLACK``, are allowed for as well, and reranking goes
on until it finds no further row. So the shortlist follows the data at any size instead of a cap. k rows a query and block
leave."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .vectors import bounded_sample, kmeans, matrix, nearest_centre, unit, usable, usual_length

BOOKS, WORDS, BEAM = 16, 64, 4
#: Rows that codebooks and cells are learned on.
SAMPLE, CELL_SAMPLE, ROUNDS = 4096, 16_384, 2
FIRST, MARGIN, SLACK = 16, 2.5, 1.25
#: Rows of a block at least, queries and rows scored at once, cells, blocks besides one a cell, bytes of a block's vectors.
ROW_BLOCK, QUERY_BLOCK, TILE = 4096, 512, 4096
MOST_CELLS, MOST_BLOCKS, BLOCK_BYTES = 128, 256, 1 << 27
PROBE_RECALL, PROBE_QUERIES = 0.99, 512
#: Cells whose squared distance is more than the nearest one's by no more than this share of it are visited in any case.
REACH = 0.25


class AdditiveQuantizer:
    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # BOOKS x WORDS x dim
        self.squares = (self.books**2).sum(axis=2)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 1) -> "AdditiveQuantizer":
        rng = np.random.default_rng(seed)
        n, dim = x.shape
        if not n:
            return cls(np.zeros((BOOKS, WORDS, dim)))
        books, rest = [], x.copy()
        for _ in range(BOOKS):
            centres = kmeans(rest, WORDS, 5, rng)
            rest -= centres[((centres**2).sum(axis=1)[None, :] - 2 * rest @ centres.T).argmin(axis=1)]
            books.append(centres)
        out = cls(np.array(books))
        for _ in range(ROUNDS):
            chosen = out.encode(x).astype(np.int64) + np.arange(BOOKS) * WORDS
            used = np.zeros((n, BOOKS * WORDS), dtype=np.float32)
            used[np.arange(n)[:, None], chosen] = 1
            gram = (used.T @ used).astype(np.float64) + 0.1 * np.eye(BOOKS * WORDS)
            # The ridge pulls towards the present codewords, so unused ones stay.
            now = out.books.reshape(-1, dim).astype(np.float64)
            out = cls(np.linalg.solve(gram, used.T.astype(np.float64) @ x + 0.1 * now).reshape(BOOKS, WORDS, dim))
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of every row; of all partial sums the ``beam`` nearest ones go on from book to book."""
        out = []
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048].astype(np.float32)
            n, row = len(part), np.arange(len(part))[:, None]
            rest, codes = part[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8)
            error = np.zeros((n, 1), dtype=np.float32)
            for book, square in zip(self.books, self.squares, strict=True):
                width = rest.shape[1]
                gain = (error[:, :, None] + square[None, None, :] - 2 * (rest.reshape(n * width, -1) @ book.T).reshape(n, width, WORDS)).reshape(n, -1)
                keep = min(beam, gain.shape[1])
                best = np.argpartition(gain, keep - 1, axis=1)[:, :keep]
                parent, word = best // WORDS, best % WORDS
                rest = rest[row, parent] - book[word]
                codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.uint8)], axis=2)
                error = gain[row, best]
            out.append(codes[np.arange(n), error.argmin(axis=1)])
        return np.concatenate(out) if out else np.zeros((0, BOOKS), np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(BOOKS)[None, :], codes.astype(np.int64)].sum(axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        return (queries.astype(np.float32) @ self.books.reshape(-1, self.books.shape[2]).T).reshape(len(queries), BOOKS, WORDS)

    @staticmethod
    def estimates(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Cosine estimates, queries by rows, by lookups alone."""
        out = np.zeros((len(tables), len(codes)), dtype=np.float32)
        for m in range(BOOKS):
            out += np.take(tables[:, m], codes[:, m], axis=1)
        return out / norms.astype(np.float32)[None, :]


class Cells:
    """The coarse codebook, and how many cells a query visits."""

    def __init__(self, sample: np.ndarray, cells: int, k: int):
        self.centres = kmeans(sample, cells, 8, np.random.default_rng(4))
        self.probes = 1
        if cells > 1 and len(sample) > 1:
            queries = sample[np.random.default_rng(5).permutation(len(sample))[:PROBE_QUERIES]]
            score = queries @ sample.T
            score[score > 1 - 1e-9] = -2  # the query itself and its copies, which lie in its own cell
            found = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, :k]
            place = np.empty((len(queries), cells), np.int64)
            np.put_along_axis(place, self.order(queries), np.arange(cells)[None, :], axis=1)
            ranks = np.take_along_axis(place, nearest_centre(sample, self.centres)[found], axis=1)
            self.probes = 1 + int(np.quantile(ranks, PROBE_RECALL, method="higher"))

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of unit vectors to all centres."""
        return np.maximum(1 + (self.centres**2).sum(axis=1)[None, :] - 2 * x @ self.centres.T, 0)

    def order(self, x: np.ndarray) -> np.ndarray:
        return self.squares(x).argsort(axis=1, kind="stable")

    def visited(self, x: np.ndarray) -> list[np.ndarray]:
        """The cells of each query, nearest first."""
        far, order = self.squares(x), self.order(x).astype(np.int32)
        near = (far <= (1 + REACH) * far.min(axis=1, keepdims=True)).sum(axis=1)
        return [row[: max(self.probes, n)] for row, n in zip(order, near.tolist(), strict=True)]


def _index(batches: Iterator[pa.RecordBatch], model, cells, dim: int) -> Iterator[pa.RecordBatch]:
    model, cells = model.value, cells.value
    for batch in batches:
        if not batch.num_rows:
            continue
        x = unit(matrix(batch.column(1), dim))
        codes = model.encode(x)
        near = model.decode(codes)
        norms = np.maximum(np.linalg.norm(near, axis=1), 1e-6).astype(np.float64)
        rest = np.linalg.norm(x - near / norms[:, None], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest_centre(x, cells.centres), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(rest)], names=["id", "v", "cell", "codes", "norm", "rest"])


def _visits(batches: Iterator[pa.RecordBatch], cells, dim: int) -> Iterator[pa.RecordBatch]:
    """A query with the cells that it visits."""
    cells = cells.value
    for batch in batches:
        if batch.num_rows:
            found = cells.visited(unit(matrix(batch.column(1), dim)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "v", "cells"])


class _Block:
    """Rows of a block, as they come in."""

    def __init__(self, model: AdditiveQuantizer, k: int, dim: int):
        self.model, self.k, self.dim = model, k, dim
        self.parts: list[tuple] = []

    def add(self, part: pa.RecordBatch) -> None:
        """Vectors stay in their own type, and codes are bytes: a row takes little more than its vector."""
        codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, BOOKS)
        v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        self.parts.append((part.column("id").to_numpy(), v, codes, part.column("norm").to_numpy(), part.column("rest").to_numpy()))

    def search(self, asks: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest rows of the block for each query: (query, row, cosine)."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]
        tables, best, share = self.model.tables(q), np.full((len(q), self.k), -np.inf), np.full(len(q), MARGIN / np.sqrt(self.dim))
        found: list[tuple] = []
        for at in range(0, len(self.parts[0][0]), TILE):
            a, ids, score, place = self._nearest([x[at : at + TILE] for x in self.parts[0]], asks, q, tables, best.min(axis=1), share)
            new = np.full_like(best, -np.inf)
            new[a, place] = score
            best = -np.partition(-np.concatenate([best, new], axis=1), self.k - 1, axis=1)[:, : self.k]
            found.append((a, ids, score))
        a, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
        a, ids, score, _ = self._first(a, ids, score, len(asks))
        return asks[a], ids, score

    def _first(self, a: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """The k best of each query's rows, and their places."""
        order = np.lexsort((ids, -score, a))
        a, ids, score = a[order], ids[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
        keep = place < self.k
        return a[keep], ids[keep], score[keep], place[keep]

    def _nearest(self, rows: list[np.ndarray], asks: np.ndarray, q: np.ndarray, tables: np.ndarray, floor: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of a tile, without rows that cannot displace a query's ``floor``, the k-th best of earlier tiles.

        ``share`` is how much of its residual an estimate may be off, for each query; it grows with what is seen here."""
        ids, v, codes, norms, rest = rows
        x = unit(v.astype(np.float64))
        about = self.model.estimates(tables, codes.astype(np.int64), norms)
        own = asks[:, None] == ids[None, :]
        about[own] = -9  # the query itself
        first = min(FIRST + self.k, len(ids))
        a, b = np.repeat(np.arange(len(asks)), first), np.argpartition(-about, first - 1, axis=1)[:, :first].reshape(-1)
        done, new = own, np.zeros_like(own)
        new[a, b] = True
        got: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        while True:
            a, b = np.nonzero(new & ~done)
            if not len(a):
                break
            done[a, b] = True
            exact = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
            # Of all rows reranked so far the k best of each query stay.
            a, b, exact = (np.concatenate(c) for c in zip(got[0], (a, b, exact), strict=True))
            order = np.lexsort((ids[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            place = np.arange(len(a)) - np.searchsorted(a, np.arange(len(asks)))[a]
            a, b, exact, place = (c[place < self.k] for c in (a, b, exact, place))
            got = [(a, b, exact)]
            last = floor.copy()
            full = place == self.k - 1
            last[a[full]] = np.maximum(last[a[full]], exact[full])
            known = exact >= floor[a]
            np.maximum.at(share, a[known], SLACK * ((exact - about[a, b]) / np.maximum(rest[b], 1e-9))[known])
            np.minimum(share, 1, out=share)  # of the whole residual
            new = about + share[:, None] * rest[None, :] >= last[:, None]
        a, b, exact = got[0]
        return self._first(a, ids[b], exact, len(asks))


def _search(batches: Iterator[pa.RecordBatch], model, k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """Streams of (block, asks, ...) sorted by block, rows before queries: memory is that of one block."""
    model, now, block = model.value, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((names[1:] != names[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if names[a] != now:
                now, block = names[a], _Block(model, k, dim)
            part = batch.slice(a, b - a)
            if not asks[a]:
                block.add(part)
                continue
            for at in range(0, part.num_rows, QUERY_BLOCK):
                some = part.slice(at, QUERY_BLOCK)
                found = block.search(some.column("id").to_numpy(), unit(matrix(some.column("v"), dim)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])


class _Index(NamedTuple):
    """A table of encoded rows with its broadcast quantizer and cells, and the rows of a block."""

    table: DataFrame
    model: Broadcast
    cells: Broadcast
    dim: int
    block_rows: int


def build_index(rows: DataFrame, k: int, id_col: str, vector_col: str) -> _Index:
    spark = rows.sparkSession
    wanted = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    dim, n = usual_length(wanted)
    wanted = wanted.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    sample = bounded_sample(wanted, CELL_SAMPLE, max(dim, 1))
    model = spark.sparkContext.broadcast(AdditiveQuantizer.fit(sample[:SAMPLE]))  # BOOKS x WORDS x dim floats
    cells = spark.sparkContext.broadcast(Cells(sample, min(-(-n // ROW_BLOCK) or 1, MOST_CELLS), k))  # MOST_CELLS x dim floats at most
    kind = wanted.schema["v"].dataType.simpleString()
    table = materialize(wanted.mapInArrow(partial(_index, model=model, cells=cells, dim=dim), f"id long, v {kind}, cell int, codes binary, norm double, rest double"))
    return _Index(table, model, cells, dim, max(ROW_BLOCK, min(-(-n // MOST_BLOCKS), BLOCK_BYTES // (8 * max(dim, 1)))))


def meetings(index: _Index, is_query) -> DataFrame:
    """``block, asks, id, v, codes, norm, rest``: each row in its block, and each query in all blocks of its cells."""
    blocks = [1] * len(index.cells.value.centres)
    for r in index.table.groupBy("cell").count().collect():  # MOST_CELLS rows at most
        blocks[r["cell"]] = -(-r["count"] // index.block_rows)
    of = F.element_at(F.lit(blocks), F.col("cell") + 1)
    block = lambda within: (F.col("cell").cast("long") * F.lit(1 << 40) + within).alias("block")
    stored = index.table.select(block(F.pmod(F.xxhash64("id"), of)), F.lit(False).alias("asks"), "id", "v", "codes", "norm", "rest")
    kind = index.table.schema["v"].dataType.simpleString()
    queries = index.table.where(is_query(F.col("id"))).select("id", "v").mapInArrow(partial(_visits, cells=index.cells, dim=index.dim), f"id long, v {kind}, cells array<int>")
    queries = queries.select("id", "v", F.explode("cells").alias("cell")).select("id", "v", "cell", F.explode(F.sequence(F.lit(0), of - 1)).alias("y"))
    queries = queries.select(block(F.col("y")), F.lit(True).alias("asks"), "id", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("rest"))
    return stored.unionByName(queries)


def nearest(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows by cosine of every row for which ``is_query(id)``.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another length than
    the commonest, nor null ids. Scores are exact cosines of the original vectors; ties go to the smaller id. Of rows
    with one id the one with the lowest vector counts. An empty table has no neighbours; other columns are not read.
    """
    index = build_index(rows, k, id_col, vector_col)
    met = meetings(index, is_query).repartition("block").sortWithinPartitions("block", "asks")
    found = met.mapInArrow(partial(_search, model=index.model, k=k, dim=index.dim), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

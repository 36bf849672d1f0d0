"""Vector code compression: product codebooks learned in exact integers by a reduction tree over columnar blocks.

Vectors become integers, floor(256 x), and are cut into equal consecutive parts; each part position has a codebook. A
block holds some thousand vectors by columns, one row of integers a dimension, as one binary row of a table in the shared
folder; every round reads it as an RDD of NumPy arrays. ``treeAggregate`` sums in tasks: distances to all entries of a
codebook accumulate dimension by dimension, ``np.add.at`` adds components and counts to int64 tensors of one size whatever
the number of vectors, and these merge through a tree, so the driver receives one tensor from each of a few tasks. Codebooks
go out as broadcasts of entries x dimensions integers. All sums are of integers: the result doesn't depend on how rows are
dealt out, and a lost executor's blocks are summed again without a trace.

Vectors of other lengths than the longest one, rounded up to a multiple of the parts, count as filled up with zeros. Integers
are 64 bits wide, or Python's own, exact ones where squared distances of the largest component might not fit."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_join, spread

#: Vectors of a block, and the largest value of Spark's long, at which errors stop.
BLOCK_ROWS, LONGEST = 4096, (1 << 63) - 1
#: Levels of the reduction tree.
DEPTH = 3


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, v`` of rows whose vector is not null and has neither null nor non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def floors(flat: np.ndarray, exact: bool) -> np.ndarray:
    """floor(256 x) as int64, or as Python integers, which no double is too large for."""
    if not exact:
        return np.floor(flat * 256.0).astype(np.int64)
    return np.array([math.floor(x * 256.0) if abs(x) < 1e300 else int(x) * 256 for x in flat.tolist()], dtype=object)


def columns(lists: pa.Array, dim: int, exact: bool) -> np.ndarray:
    """Integers of a block, a row a dimension; vectors shorter than ``dim`` are filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = floors(lists.flatten().to_numpy(zero_copy_only=False), exact)
    if (sizes == dim).all():
        return np.ascontiguousarray(flat.reshape(-1, dim).T)
    out = np.zeros((dim, len(sizes)), dtype=object if exact else np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return out


def pack_block(block: np.ndarray, exact: bool) -> bytes:
    return "\n".join(",".join(map(str, row)) for row in block.tolist()).encode() if exact else block.tobytes()


def unpack_block(data: bytes, dim: int, exact: bool) -> np.ndarray:
    if not exact:
        return np.frombuffer(data, dtype=np.int64).reshape(dim, -1)
    return np.array([[int(x) for x in line.split(",")] for line in data.decode().split("\n")], dtype=object).reshape(dim, -1)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, exact: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            ids = pa.ListArray.from_arrays([0, part.num_rows], part.column(0))
            labels = pa.ListArray.from_arrays([0, part.num_rows], part.column(1))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([pack_block(columns(part.column(2), dim, exact), exact)], pa.binary())], names=["ids", "labels", "data"])


def assign(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each column of ``part`` and its squared distance, ties to the lower index.

    ``part`` is dimensions x vectors, ``entries`` is entries x dimensions; a table of entries x vectors takes one
    dimension's squares after another."""
    far = np.zeros((len(entries), part.shape[1]), dtype=part.dtype)
    for values, centres in zip(part, entries.T, strict=True):
        step = values[None, :] - centres[:, None]
        step *= step
        far += step
    near = far.argmin(axis=0)
    return near, far[near, np.arange(part.shape[1])]


def add_block(sums: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds a block to the sums (parts x entries x width) and counts (parts x entries) of the entries it is nearest to."""
    totals, counts = sums
    for p, entries in enumerate(books):
        part = block[p * books.shape[2] : (p + 1) * books.shape[2]]
        near, _ = assign(part, entries)
        np.add.at(totals[p], near, part.T)
        np.add.at(counts[p], near, 1)
    return totals, counts


def merge_sums(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def first_codebooks(rows: DataFrame, parts: int, entries: int, dim: int, exact: bool) -> np.ndarray:
    """parts x entries x width integers: the parts of the vectors of smallest ids; a null id comes last, equal ids stand
    in the order of their vectors. ``entries`` rows reach the driver, whatever the table."""
    top = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    out = np.zeros((len(top), dim), dtype=object if exact else np.int64)
    for row, r in zip(out, top, strict=True):
        row[: len(r.v)] = floors(np.array(r.v, dtype=np.float64), exact)
    return np.ascontiguousarray(out.reshape(len(top), parts, dim // parts).transpose(1, 0, 2))


def fit_codebooks(blocks: DataFrame, books: np.ndarray, rounds: int, exact: bool) -> np.ndarray:
    """Codebooks after ``rounds`` of assigning all parts and moving entries to floor(sum / count); unused ones stay."""
    context, (parts, entries, width) = blocks.sparkSession.sparkContext, books.shape
    arrays = blocks.select("data").rdd.map(lambda r: unpack_block(bytes(r.data), parts * width, exact))
    for _ in range(rounds):
        shared = context.broadcast(books)
        zero = (np.zeros((parts, entries, width), dtype=books.dtype), np.zeros((parts, entries), dtype=np.int64))
        totals, counts = arrays.treeAggregate(zero, lambda sums, block, shared=shared: add_block(sums, block, shared.value), merge_sums, DEPTH)
        used = counts > 0
        books = books.copy()
        books[used] = totals[used] // counts[used][:, None]
        shared.unpersist()
    return books


def _encode(batches: Iterator[pa.RecordBatch], books, exact: bool) -> Iterator[pa.RecordBatch]:
    books = books.value
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])
    for batch in batches:
        for n in range(batch.num_rows):
            ids, labels = batch.column(0).slice(n, 1).flatten(), batch.column(1).slice(n, 1).flatten()
            block = unpack_block(batch.column(2)[n].as_py(), parts * width, exact)
            error, code = np.zeros(len(ids), dtype=block.dtype), np.full(len(ids), "")
            for p in range(parts):
                near, far = assign(block[p * width : (p + 1) * width], books[p])
                error = error + far
                code = np.char.add(code, digits[near])
            error = pa.array([min(int(e), LONGEST) for e in error] if exact else error, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code.tolist(), pa.string()), error], names=["id", "label", "code", "error"])


def codebook_digest(books: np.ndarray) -> str:
    """Of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``id_col, label_col, code, error`` of every usable vector, and the codebooks (parts x entries x width).

    ``code`` has two hex digits a part, so ``entries`` is at most 256; ``error`` is the squared distance of the integers
    to their entries, summed over parts, at most the largest long. Rows whose vector is null or has null or non-finite
    components go; the zero and the empty vector stay. Vectors shorter than the longest one are filled up with zeros.
    Repeated rows are coded each; of repeated or null ids the order is that of ``first_codebooks``. With fewer usable
    vectors than entries a codebook has one entry a vector; without any there are no rows. Labels and further columns
    have no say."""
    if not 0 < entries <= 256:
        raise ValueError(f"{entries} entries are not written by two hex digits")
    rows = kept_vectors(vectors, id_col, vector_col, label_col)
    # abs() of each component, not of each vector: the longest vector and the largest component in one pass.
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0.0))
    seen = rows.agg(F.max(F.size("v")).alias("d"), F.max(largest).alias("m")).first()
    dim = parts * max(1, -(-(seen.d or 1) // parts))
    exact = dim * (2 * 256 * (seen.m or 0.0) + 2) ** 2 >= 2.0**62
    books = first_codebooks(rows, parts, entries, dim, exact)
    kind, label = (dict(rows.dtypes)[c] for c in ("id", "label"))
    blocks = materialize(spread(rows).mapInArrow(partial(_blocks, dim=dim, exact=exact), f"ids array<{kind}>, labels array<{label}>, data binary"))
    books = fit_codebooks(blocks, books, rounds, exact) if books.size else books
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    coded = blocks.mapInArrow(partial(_encode, books=shared, exact=exact), f"id {kind}, label {label}, code string, error long")
    return coded.withColumnsRenamed({"id": id_col, "label": label_col}), books


def with_label_error(coded: DataFrame, label_col: str = "label", id_col: str = "vec_id") -> DataFrame:
    """Adds ``label_error``, the errors of equal labels summed, nulls together; a label of a third of all rows is salted.

    Sums stop at the largest long, as errors do."""
    keyed = coded.withColumn("_null", F.col(label_col).isNull()).withColumn("_key", F.coalesce(F.col(label_col).cast("string"), F.lit("")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = keyed.groupBy("_null", "_key").agg(total.alias("label_error"), F.count("*").alias("n"))
    return salted_join(keyed, sums, ["_null", "_key"], coded.count(), id_col).drop("_null", "_key")

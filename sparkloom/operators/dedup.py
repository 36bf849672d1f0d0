"""Exact and near-duplicate removal: MinHash signatures, LSH bands, and the order-faithful greedy resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.settings import warn_of_unknown
from ..sources.checkpoint import drop_table, materialize
from .blake2b import signatures_of

PRIME = (1 << 61) - 1
#: Texts whose signatures are held at once.
SIGNED_ROWS = 512


def optimal_bands(num_perm: int, threshold: float) -> tuple[int, int]:
    """Bands and rows whose product is num_perm and whose curve's midpoint is nearest to the threshold."""
    best = min((abs(threshold - (1 / b) ** (b / num_perm)), b) for b in range(1, num_perm + 1) if num_perm % b == 0)
    return best[1], num_perm // best[1]


def permutations(num_perm: int, seed: int = 1) -> tuple[list[int], list[int]]:
    """Coefficients of the permutations a x + b; a is drawn first."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, (1 << 32) - 1, size=num_perm, dtype=np.uint64)
    b = rng.integers(0, (1 << 32) - 1, size=num_perm, dtype=np.uint64)
    return [int(x) for x in a], [int(x) for x in b]


def hash32(s: Column) -> Column:
    """32 bits of MD5: the native shingle hash."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def permuted(x: Column, a: int, b: int) -> Column:
    """(a x + b) mod 2^61 - 1 in signed longs: the product is taken in two halves and folded at bit 61."""
    y = F.lit(a) * F.shiftright(x, 16)
    low = F.shiftleft(y.bitwiseAND(F.lit((1 << 45) - 1)), 16) + F.shiftright(y, 45)
    return (low + F.lit(a) * x.bitwiseAND(F.lit(65535)) + F.lit(b)) % F.lit(PRIME)


def document_shingles(docs: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """A row (id, s) for each distinct shingle; a document without any has one row with a null.

    The inner ``explode`` would make Spark filter by the size of the shingle array and split the text anew inside it;
    the outer one is computed once."""
    split_ = docs.select(id_col, F.explode_outer(F.array(t.words(F.col("text")))).alias("w"))
    return split_.select(id_col, F.explode_outer(t.shingles_of(F.col("w"), k)).alias("s"))


def signatures(docs: DataFrame, num_perm: int = 16, k: int = 5, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """``id, sig array<bigint>`` with the native hash. Minima combine before the shuffle, so a document is one row there."""
    a, b = permutations(num_perm, seed)
    hashed = document_shingles(docs, k, id_col).select(id_col, hash32(F.col("s")).alias("h"))
    mins = hashed.groupBy(id_col).agg(*[F.coalesce(F.min(permuted(F.col("h"), a[i], b[i])), F.lit(PRIME)).alias(f"m{i}") for i in range(num_perm)])
    return mins.select(id_col, F.array(*[f"m{i}" for i in range(num_perm)]).alias("sig"))


def signatures_blake2b(docs: DataFrame, num_perm: int = 128, k: int = 5, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Signatures as other tools of this kind compute them; Spark has no BLAKE2b, so Arrow batches are hashed in NumPy."""
    coefficients = permutations(num_perm, seed)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (np.array(x, dtype=np.uint64) for x in coefficients)
        for batch in batches:
            for at in range(0, batch.num_rows, SIGNED_ROWS):
                ids, texts = (c.slice(at, SIGNED_ROWS) for c in batch.columns)
                found = signatures_of(texts.to_pylist(), k, a, b).view(np.int64)
                ends = np.arange(len(ids) + 1, dtype=np.int32) * np.int32(num_perm)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))], names=[id_col, "sig"])

    rows = docs.select(id_col, "text")
    return rows.mapInArrow(sign, T.StructType([rows.schema[id_col], T.StructField("sig", T.ArrayType(T.LongType()))]))


def bands(signed: DataFrame, n_bands: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """``band, key, id``: the key is the slice of the signature itself, so no two keys collide."""
    slices = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.slice("sig", b * rows + 1, rows))
    return signed.select(id_col, F.posexplode(slices).alias("band", "key"))


def estimated_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.size(a)


def owner_pairs(signed: DataFrame, n_bands: int, rows: int, id_col: str = "doc_id") -> DataFrame:
    """Each document with the earliest document of each of its buckets: rows in proportion to documents, not pairs."""
    banded = bands(signed, n_bands, rows, id_col)
    first = banded.groupBy("band", "key").agg(F.min(id_col).alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    return banded.join(first, ["band", "key"]).where(F.col("owner") != F.col(id_col)).select("owner", id_col).distinct()


def section_keys(num_perm: int, threshold: float, levels: int = 2) -> list[list[int]]:
    """Sets of places of which every two signatures of that similarity agree on at least one set.

    With at most m places that differ, one of m + 1 sections agrees throughout; of the places outside it, at most m
    differ too, so one of m + 1 sections of these agrees as well, and so on for each level."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold} is not in (0, 1]")
    parts = num_perm - min(c for c in range(num_perm + 1) if c / num_perm >= threshold) + 1
    found: list[list[int]] = [[]]
    for _ in range(levels):
        found = [s + rest.tolist() for s in found for rest in np.array_split([i for i in range(num_perm) if i not in s], parts)]
    return found


def signature_links(signed: DataFrame, num_perm: int, threshold: float, levels: int = 2, id_col: str = "doc_id") -> DataFrame:
    """``owner, id, similarity``: all links of signatures whose estimated similarity reaches the threshold, none lost.

    Equal signatures are one class, named by its smallest id: a row ties each other member to it with similarity 1, so
    copies are never expanded into pairs. Between the smallest ids of different classes there is a row for each link.
    Classes meet by the values of ``section_keys``, as hashes; with two levels and 16 places at 0.8 those that meet
    agree on seven places. The number of keys is a matter of num_perm and threshold: 16 here, 26 at 128 and one level."""
    classes = materialize(signed.groupBy("sig").agg(F.min(id_col).alias("owner")))
    members = signed.join(classes, "sig").where(F.col(id_col) != F.col("owner")).select("owner", id_col, F.lit(1.0).alias("similarity"))
    keys = [F.xxhash64(F.lit(n), *[F.element_at("sig", i + 1) for i in places]) for n, places in enumerate(section_keys(num_perm, threshold, levels))]
    # Ids and keys alone are shuffled for it; signatures go to the pairs that met, once each.
    keyed = classes.select("owner", F.explode(F.array(*keys)).alias("key"))
    met = keyed.join(keyed.select(F.col("owner").alias(id_col), "key"), "key").where(F.col("owner") < F.col(id_col)).select("owner", id_col).distinct()
    other = classes.select(F.col("owner").alias(id_col), F.col("sig").alias("y"))
    links = met.join(classes, "owner").join(other, id_col).select("owner", id_col, estimated_jaccard(F.col("sig"), F.col("y")).alias("similarity"))
    return members.unionByName(links.where(F.col("similarity") >= threshold))


def greedy_duplicates(signed: DataFrame, n_bands: int, rows: int, threshold: float, id_col: str = "doc_id") -> DataFrame:
    """Ids that a sequential pass in order of id drops: a document goes if it resembles the owner of one of its buckets,
    the owner being the earliest kept document there.

    Rounds: in each bucket the earliest document not dropped is the owner if it is kept already. A document is dropped
    once a settled owner resembles it, and kept once each of its buckets is its own or has a settled owner that does
    not. The earliest open document can always be decided, so rounds end; each ends in a table, which goes
    with the next round; only the last one stays, for the result."""
    signed = materialize(signed)
    banded = bands(signed, n_bands, rows, id_col).withColumnRenamed(id_col, "d")
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    entries = materialize(banded.join(shared, ["band", "key"]).select("band", "key", "d"))
    state = materialize(entries.select("d").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    sig = signed.select(F.col(id_col).alias("d"), "sig")
    while True:
        live = entries.join(state, "d").where("kept is null or kept")
        low = live.groupBy("band", "key").agg(F.min(F.struct("d", F.coalesce(F.col("kept"), F.lit(False)).alias("kept"))).alias("m"))
        seen = live.where("kept is null").join(low, ["band", "key"]).select("d", F.col("m.d").alias("owner"), F.col("m.kept").alias("settled")).distinct()
        judged = seen.join(sig.select("d", F.col("sig").alias("s")), "d").join(sig.select(F.col("d").alias("owner"), F.col("sig").alias("o")), "owner")
        close = (F.col("d") != F.col("owner")) & F.col("settled") & (estimated_jaccard(F.col("s"), F.col("o")) >= threshold)
        clear = (F.col("d") == F.col("owner")) | (F.col("settled") & ~close)
        decided = judged.groupBy("d").agg(F.bool_or(close).alias("dup"), F.bool_and(clear).alias("free"))
        verdict = F.when(F.col("dup"), F.lit(False)).when(F.col("free"), F.lit(True))
        before, state = state, materialize(state.join(decided, "d", "left").select("d", F.coalesce("kept", verdict).alias("kept")))
        drop_table(before)
        if state.where("kept is null").isEmpty():
            drop_table(signed)
            drop_table(entries)
            return state.where(~F.col("kept")).select(F.col("d").alias(id_col))


def minhash_dedup(docs: DataFrame, num_perm: int = 128, threshold: float = 0.8, k: int = 5, seed: int = 1, hash: str = "blake2b", id_col: str = "doc_id") -> DataFrame:
    n_bands, rows = optimal_bands(num_perm, threshold)
    sign = signatures_blake2b if hash == "blake2b" else signatures
    return docs.join(greedy_duplicates(sign(docs, num_perm, k, seed, id_col), n_bands, rows, threshold, id_col), id_col, "left_anti")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of texts equal up to white space the earliest. The hash, not the text, is grouped, and combines before the
    shuffle, so a text that a third of all rows repeat is no hot task."""
    firsts = docs.select(F.md5(t.normalise_space(F.col("text"))).alias("h"), id_col).groupBy("h").agg(F.min(id_col).alias(id_col)).select(id_col)
    return docs.join(firsts, id_col, "left_semi")


#: Keys of the configuration's part on dedup; ``hash`` and ``seed`` are this engine's own.
DEDUP_KEYS = ("enabled", "method", "num_perm", "jaccard_threshold", "shingle_size", "hash", "seed")


def keep_all(docs: DataFrame) -> DataFrame:
    return docs


def build_deduper(config: dict | None) -> Callable[[DataFrame], DataFrame]:
    """From a configuration: none, exact or minhash; another name is an error, another key is warned of."""
    config = warn_of_unknown("dedup", config, DEDUP_KEYS)
    method = config.get("method", "minhash") if config and config.get("enabled", True) else "none"
    if method == "none":
        return keep_all
    if method == "exact":
        return lambda docs: exact_dedup(docs, "ord")
    if method == "minhash":
        return lambda docs: minhash_dedup(docs, config.get("num_perm", 128), config.get("jaccard_threshold", 0.8), config.get("shingle_size", 5), config.get("seed", 1), config.get("hash", "blake2b"), "ord")
    raise ValueError(f"unknown dedup method {method!r}")


def dedup_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    counts = before.agg(F.count("*").alias("seen"), F.lit(0).cast("long").alias("kept")).unionByName(after.agg(F.lit(0).cast("long").alias("seen"), F.count("*").alias("kept")))
    return counts.agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept")).select("seen", (F.col("seen") - F.col("kept")).alias("duplicates_removed"), "kept")

"""Helpers shared by the training-data operators: checkpoints, bounded samples, batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; one longer text is a step of its own. The arrays of a step of
#: ``quality`` take some 130 times as much (measured), and workers keep part of it for the stages that follow.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a default of ours where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a table that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, through Hadoop's file system, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than 1 / HOT_SHARE of all rows is hot; its rows are joined by SALTS keys.
HOT_SHARE, SALTS = 1024, 64


def salted_join(rows: DataFrame, stats: DataFrame, keys: list[str], total: int, by: str) -> DataFrame:
    """Inner join of ``rows`` with ``stats``, one row a key with ``n``, the rows of that key, of ``total`` in all.

    Hot keys are spread over tasks by a hash of the column ``by``. There are fewer than HOT_SHARE of them, whatever the
    size, so their table is broadcast; everything else is merge-joined, as it has no bound."""
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(stats.where(is_hot).select(*keys, F.lit(True).alias("_hot")))
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    salts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(stats.withColumn("_salt", F.explode(salts)).drop("n").hint("merge"), [*keys, "_salt"]).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the scan has fewer partitions than the cluster has cores (a file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def crc32_mod(column, n: int):
    """crc32 of the id written as decimal text, modulo n; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")) % n


def lowest_hashes(wanted: int, rows: int) -> int:
    """The signed 64-bit number up to which the hashes of about ``wanted`` of ``rows`` rows lie."""
    return (1 << 63) - 1 if wanted >= rows else -(1 << 63) + (1 << 64) * wanted // rows


def smallest_by_hash(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, those whose key hashes lowest: a uniform sample that doesn't depend on partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(limit)


def text_slices(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array of about ``most`` bytes each."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, min(stop, n)
        start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets of its rows; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]

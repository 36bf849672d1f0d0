"""Sinks: clean corpus, packed token streams, manifest and report."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clean(docs: DataFrame, path: str) -> None:
    docs.select("ord", "text", "source", "kind").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json_lines(docs: DataFrame, path: str, compression: str = "gzip") -> None:
    docs.select(F.to_json(F.struct("text", "source", "kind")).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_packed(rows: DataFrame, path: str, dtype: str) -> None:
    """``split, pos, ids`` as binary records in order of position; ``export_binary`` joins them to one file a split.
    Rows with a ``shard`` are in a folder for each of these."""
    by = ["split", "shard"] if "shard" in rows.columns else ["split"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's ids at once: its values behind each other are the records' bytes."""
        for batch in batches:
            ids = batch.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), dtype=np.int64) * values.itemsize
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), batch.column("pos"), data], names=[*by, "pos", "data"])

    packed = rows.select(*by, "pos", "ids").mapInArrow(encode, ("split string, shard long" if len(by) > 1 else "split string") + ", pos long, data binary")
    packed.repartitionByRange("split", "pos").sortWithinPartitions("split", "pos").write.mode("overwrite").partitionBy(*by).parquet(path)


def export_binary(spark: SparkSession, path: str, split: str, file) -> int:
    """Stream a packed split into an open binary file, partition by partition, for trainers that map a flat file."""
    rows = spark.read.parquet(path).where(F.col("split") == split).orderBy("pos").select("data")
    return sum(file.write(bytes(r["data"])) for r in rows.toLocalIterator())


def read_packed(spark: SparkSession, path: str, split: str, dtype: str) -> DataFrame:
    """``pos, ids`` of a packed split."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("data")
            sizes = np.asarray(pc.fill_null(pc.binary_length(data), 0), dtype=np.int64) // np.dtype(dtype).itemsize
            values = np.frombuffer(b"".join(x.as_buffer() for x in data if x.is_valid), dtype=dtype).astype(np.int32)
            ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), ids], names=["pos", "ids"])

    return spark.read.parquet(path).where(F.col("split") == split).select("pos", "data").mapInArrow(decode, "pos long, ids array<int>")


def write_text_file(spark: SparkSession, text: str, path: str) -> None:
    """One small file, by Hadoop's file system."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def report_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)

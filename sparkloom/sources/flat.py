"""A data source of flat token files: what trainers map into memory, without a byte order mark or a header.

Writing needs no order: each row knows its position, so every task writes its rows' tokens to their own place in one file
that all tasks share, under a name that nobody looks for. A task reports how many tokens it wrote and how far; the driver,
which sees these numbers alone, checks that they fill the file, gives it its name and writes the manifest beside it. A
task that is tried again writes the same bytes to the same place. If the job fails, the file goes and nothing has a name.
Reading deals the file out in ranges of bytes.

    spark.dataSource.register(FlatTokens)
    rows.select("pos", "ids").write.format("flat_tokens").option("split", "train").mode("append").save(folder)
    spark.read.format("flat_tokens").option("split", "train").load(folder)      # pos, ids

The folder is one that driver and executors share and whose files take writes at any place, as network file systems do;
stores that only take whole objects have ``writers.write_packed``."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Tokens of a partition that is read, and of one row of it; bytes of neighbouring rows that are written at once.
PARTITION_TOKENS, ROW_TOKENS, STEP = 1 << 24, 1 << 14, 1 << 22
TYPES = ("uint16", "uint32")


def local_path(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path} is not in a file system that takes writes at any place")
    return parts.path if parts.scheme else path


def token_type(name: str) -> np.dtype:
    if name not in TYPES:
        raise ValueError(f"unknown token type {name!r}")
    return np.dtype(name)


@dataclass
class Written(WriterCommitMessage):
    """Tokens of a task, where the last of them ends, and its documents."""

    tokens: int
    end: int
    rows: int


class FlatTokensWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.split, self.dtype = local_path(options["path"]), options.get("split", "train"), options.get("dtype", "uint16")
        token_type(self.dtype)
        os.makedirs(self.folder, exist_ok=True)
        self.hidden = os.path.join(self.folder, f".{self.split}-{uuid.uuid4().hex}.tmp")
        with open(self.hidden, "wb"):
            pass

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        kind, tokens, end, rows = token_type(self.dtype), 0, 0, 0
        handle = os.open(self.hidden, os.O_WRONLY)  # an aborted job's file is not made anew
        try:
            for batch in iterator:
                lists, places = batch.column("ids"), batch.column("pos")
                if places.null_count or lists.null_count:
                    raise ValueError("a row without a position or without tokens")
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(kind).max):
                    raise ValueError(f"a token is no {self.dtype}")
                sizes, data = np.diff(lists.offsets.to_numpy()).astype(np.int64), ids.astype(kind)
                pos = places.to_numpy().astype(np.int64)
                # Rows that follow each other in the file go out together.
                new = np.append(True, pos[1:] != pos[:-1] + sizes[:-1]) if len(pos) else np.zeros(0, dtype=bool)
                first = np.flatnonzero(new)
                starts = np.cumsum(sizes) - sizes
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(pos)], strict=True):
                    view = memoryview(data[starts[a] : starts[b - 1] + sizes[b - 1]].tobytes())
                    at = int(pos[a]) * kind.itemsize
                    while view:
                        done = os.pwrite(handle, view[:STEP], at)
                        view, at = view[done:], at + done
                tokens += int(sizes.sum())
                rows += len(pos)
                end = max(end, int((pos + sizes).max()) if len(pos) else 0)
            os.fsync(handle)
        finally:
            os.close(handle)
        return Written(tokens, end, rows)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        tokens, end = sum(m.tokens for m in done), max((m.end for m in done), default=0)
        size = os.path.getsize(self.hidden)
        if tokens != end or size != end * token_type(self.dtype).itemsize:
            os.remove(self.hidden)
            raise ValueError(f"{tokens} tokens don't fill a file of {end}: positions have gaps or overlap")
        os.replace(self.hidden, os.path.join(self.folder, f"{self.split}.bin"))
        manifest = {"dtype": self.dtype, "file": f"{self.split}.bin", "tokens": tokens, "n_docs": sum(m.rows for m in done)}
        name = os.path.join(self.folder, f"{self.split}.json")
        with open(f"{name}.tmp", "w", encoding="utf-8") as f:
            json.dump(manifest, f, indent=2)
        os.replace(f"{name}.tmp", name)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class TokenRange(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class FlatTokensReader(DataSourceReader):
    def __init__(self, options: dict):
        folder, split = local_path(options["path"]), options.get("split", "train")
        with open(os.path.join(folder, f"{split}.json"), encoding="utf-8") as f:
            manifest = json.load(f)
        self.file, self.dtype, self.tokens = os.path.join(folder, manifest["file"]), manifest["dtype"], manifest["tokens"]
        self.step = int(options.get("partitionTokens", PARTITION_TOKENS))

    def partitions(self) -> list[InputPartition]:
        return [TokenRange(at, min(at + self.step, self.tokens)) for at in range(0, self.tokens, self.step)]

    def read(self, partition: TokenRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without partitions is read once all the same
            return
        kind = token_type(self.dtype)
        with open(self.file, "rb") as f:
            f.seek(partition.begin * kind.itemsize)
            for at in range(partition.begin, partition.end, 64 * ROW_TOKENS):
                stop = min(at + 64 * ROW_TOKENS, partition.end)
                ids = np.frombuffer(f.read((stop - at) * kind.itemsize), dtype=kind).astype(np.int32)
                starts = np.arange(at, stop, ROW_TOKENS, dtype=np.int64)
                ends = np.append(starts[1:], stop) - at
                lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(starts), lists], names=["pos", "ids"])


class FlatTokens(DataSource):
    """Options: ``path`` (a shared folder), ``split`` (names the file), ``dtype`` to write, ``partitionTokens`` to read."""

    @classmethod
    def name(cls) -> str:
        return "flat_tokens"

    def schema(self) -> str:
        return "pos long, ids array<int>"

    def writer(self, schema, overwrite: bool) -> FlatTokensWriter:
        return FlatTokensWriter(self.options)

    def reader(self, schema) -> FlatTokensReader:
        return FlatTokensReader(self.options)

"""A data source of zstd-compressed lines whose partitions are the frames of a file.

A file made of independent frames is a concatenation of them, and each frame can be read by itself. The driver walks the
frame and block headers of each file, some bytes a block, and never reads compressed data; it makes one partition of each
run of frames of some size. A task seeks to its frames and decompresses them piece by piece, so no task holds a whole file
or a whole frame. A line belongs to the task with the break before it: that task reads on up to the line's end, and a task
that doesn't begin a file drops what stands before its first break.

    spark.dataSource.register(ZstdLines)
    spark.read.format("zstd_lines").load("/folder/*.jsonl.zst")     # file, frame, value

Files are opened through ``pyarrow.fs``, so a path may be a local one or a URI that it knows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Marks of a frame and of the frames to skip, from the published format.
FRAME_MAGIC, SKIP_MAGIC = 0xFD2FB528, 0x184D2A50
#: Compressed bytes up to which frames share a partition, and bytes read or written at once.
PARTITION_BYTES, STEP = 1 << 22, 1 << 18
SCHEMA = "file string, frame long, value string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header_size(descriptor: int) -> int:
    """Bytes of a frame header behind its mark, from its first byte."""
    single = descriptor >> 5 & 1
    dictionary = (0, 1, 2, 4)[descriptor & 3]
    content = (single, 2, 4, 8)[descriptor >> 6]
    return 1 + (not single) + dictionary + content


def frames(file: pa.NativeFile, size: int) -> Iterator[tuple[int, int, bool]]:
    """Begin and end of each frame of a file, and whether it holds data (others are to be skipped)."""
    at = 0
    while at < size:
        begin = at
        file.seek(at)
        head = file.read(8)
        if len(head) < 8:
            raise ValueError(f"a frame's header is cut off at byte {begin}")
        mark, length = struct.unpack("<II", head)
        if mark & 0xFFFFFFF0 == SKIP_MAGIC:
            at += 8 + length
            yield begin, at, False
            continue
        if mark != FRAME_MAGIC:
            raise ValueError(f"no frame begins at byte {begin}")
        at += 4 + header_size(head[4])
        last = False
        while not last:
            file.seek(at)
            block = file.read(3)
            if len(block) < 3:
                raise ValueError(f"the frame of byte {begin} is cut off")
            number = int.from_bytes(block, "little")
            last, kind, length = bool(number & 1), number >> 1 & 3, number >> 3
            at += 3 + (1 if kind == 1 else length)  # a run is one byte that is repeated
        at += 4 * (head[4] >> 2 & 1)
        if at > size:
            raise ValueError(f"the frame of byte {begin} is cut off")
        yield begin, at, True


class FrameRange(InputPartition):
    """Frames from one byte of a file to another; the file's later frames begin at the second."""

    def __init__(self, path: str, begin: int, end: int, size: int):
        self.path, self.begin, self.end, self.size = path, begin, end, size


def plain_pieces(file: pa.NativeFile, begin: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Decompressed pieces of the frames from ``begin`` on, with each frame's first byte, for as long as the caller asks."""
    import zstandard

    at = begin
    while at < size:
        file.seek(at)
        head = file.read(8)
        if struct.unpack("<I", head[:4])[0] & 0xFFFFFFF0 == SKIP_MAGIC:
            at += 8 + struct.unpack("<I", head[4:])[0]
            continue
        file.seek(at)
        reader, fed = zstandard.ZstdDecompressor().decompressobj(), at
        while not reader.eof:
            data = file.read(STEP)
            if not data:
                raise ValueError(f"the frame of byte {at} is cut off")
            fed += len(data)
            # Small feeds bound what one of them may expand to.
            for k in range(0, len(data), 1 << 12):
                if reader.eof:
                    fed -= len(data) - k
                    break
                yield at, reader.decompress(data[k : k + (1 << 12)])
        at = fed - len(reader.unused_data)


def lines_of(file: pa.NativeFile, part: FrameRange) -> Iterator[tuple[int, bytes]]:
    """Lines of a partition, with the first byte of the frame that each belongs to: the one with the break before it.

    The last line of a file counts only with its own break."""
    rest, home, skipping = [], part.begin, part.begin > 0
    for frame, piece in plain_pieces(file, part.begin, part.size):
        if skipping and frame >= part.end:
            return  # one line goes on through all frames of this partition
        at = 0
        while (stop := piece.find(b"\n", at)) >= 0:
            if not skipping:
                yield home, b"".join([*rest, piece[at:stop]])
            if frame >= part.end:
                return
            rest, skipping, home, at = [], False, frame, stop + 1
        if not skipping:
            rest.append(piece[at:])


class ZstdLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def _files(self) -> list[str]:
        system, path = opened(self.path)
        if "*" in path:
            folder, name = path.rsplit("/", 1)
            head, tail = name.split("*", 1)
            found = [i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.is_file and i.base_name.startswith(head) and i.base_name.endswith(tail)]
        else:
            info = system.get_file_info(path)
            found = [i.path for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name.endswith(".zst")] if info.type == fs.FileType.Directory else [path]
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        system, _ = opened(self.path)
        out: list[InputPartition] = []
        for path in self._files():
            with system.open_input_file(path) as file:
                size, begin, filled = file.size(), 0, False
                for at, _, data in frames(file, size):
                    if data and filled and at - begin >= self.bytes:
                        out.append(FrameRange(path, begin, at, size))
                        begin = at
                    filled = filled or data
                if size:
                    out.append(FrameRange(path, begin, size, size))
        return out

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without partitions is read once all the same
            return
        system, _ = opened(self.path)
        names, schema = ["file", "frame", "value"], pa.schema([("file", pa.string()), ("frame", pa.int64()), ("value", pa.string())])
        with system.open_input_file(partition.path) as file:
            held, size = [], 0
            for frame, line in lines_of(file, partition):
                held.append((frame, line.decode("utf-8", "replace")))
                size += len(line)
                if size >= 4 * STEP:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(held)), pa.array([f for f, _ in held]), pa.array([v for _, v in held])], names=names)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(held), pa.string()), pa.array([f for f, _ in held], pa.int64()), pa.array([v for _, v in held], pa.string())], schema=schema)


class ZstdLines(DataSource):
    """Options: ``path`` (a file, a folder of .zst files, or one with a star in its name), ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZstdLinesReader:
        return ZstdLinesReader(self.options)


def read_json_lines_zstd(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``text, source, kind`` of compressed JSON lines, a partition for some frames; a missing kind is prose, a last line
    without a break is left out, and so are blank lines."""
    spark.dataSource.register(ZstdLines)
    lines = spark.read.format("zstd_lines").option("partitionBytes", str(partition_bytes)).load(path)
    row = F.from_json("value", "text string, source string, kind string").alias("row")
    return lines.where(F.trim("value") != "").select(row).select("row.text", "row.source", F.coalesce("row.kind", F.lit("prose")).alias("kind"))

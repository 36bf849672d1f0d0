"""A data source of lines that goes on where it failed, for batches and for streams.

A stream's offset is, for each file, the byte behind its last whole line, so a query that is restarted from its checkpoint
reads each line once, also of files that have grown or come since; a line that is still being written waits for its break.
A batch of the stream is all that is there, in partitions of some bytes of a file; a line belongs to the partition that it
begins in. When a read fails within a task, the file is opened again at the next byte not yet read: no line comes twice
and none is left out, whatever lines (empty ones too) came before. A source that goes on failing is an error and never cut
short; Spark then runs the task anew.

    spark.dataSource.register(ResumableLines)
    spark.readStream.format("resumable_lines").load("/folder/*.jsonl")     # file, at, value

``at`` is the byte that a line begins at, so (file, at) names a line. A file that has become shorter than an offset is an
error, as what was read of it is no longer there."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .frames import opened

SCHEMA = "file string, at long, value string"
#: Bytes of a partition, bytes read at once, reads that may fail one after the other, seconds of the first pause.
PARTITION_BYTES, STEP, RETRIES, PAUSE = 1 << 24, 1 << 20, 6, 1.0


class ResumedFile:
    """Bytes of a file from a position on. A failed read is tried again from there, after pauses that double."""

    def __init__(self, system: fs.FileSystem, path: str, at: int, retries: int = RETRIES, pause: float = PAUSE):
        self.system, self.path, self.at, self.retries, self.pause, self.file = system, path, at, retries, pause, None

    def read(self, n: int) -> bytes:
        for attempt in range(self.retries + 1):
            try:
                if self.file is None:
                    self.file = self.system.open_input_file(self.path)
                data = self.file.read_at(n, self.at)
                self.at += len(data)
                return data
            except OSError:
                self.close()
                if attempt == self.retries:
                    raise
                time.sleep(self.pause * 2**attempt)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class LineRange(InputPartition):
    """The lines that begin in [begin, end) of a file whose whole lines end at ``stop``."""

    def __init__(self, path: str, begin: int, end: int, stop: int):
        self.path, self.begin, self.end, self.stop = path, begin, end, stop


def lines_of(file: ResumedFile, part: LineRange) -> Iterator[tuple[int, bytes]]:
    """(first byte, line). Reading begins one byte early: a break there says that a line begins with the partition."""
    skipping, rest, home = part.begin > 0, [], part.begin
    file.at = part.begin - skipping
    while file.at < part.stop:
        begin = file.at
        data = file.read(min(STEP, part.stop - begin))
        if not data:
            raise OSError(f"{part.path} ends at byte {begin}, before byte {part.stop} that was there")
        at = 0
        while (found := data.find(b"\n", at)) >= 0:
            if not skipping:
                yield home, b"".join([*rest, data[at:found]])
            rest, skipping, at = [], False, found + 1
            home = begin + at
            if home >= part.end:
                return
        if not skipping:
            rest.append(data[at:])
    if rest and not skipping and any(rest):
        yield home, b"".join(rest)  # a batch's last line without a break


def whole_lines(file: ResumedFile, size: int, floor: int) -> int:
    """The byte behind the last break before ``size``, found from the end; ``floor`` if there is none behind that."""
    end = size
    while end > floor:
        begin = max(floor, end - STEP)
        file.at = begin
        data = b""
        while len(data) < end - begin and (more := file.read(end - begin - len(data))):
            data += more
        if (found := data.rfind(b"\n")) >= 0:
            return begin + found + 1
        end = begin
    return floor


class _Lines:
    """What the readers of batches and of streams share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.retries, self.pause = int(options.get("retries", RETRIES)), float(options.get("pause", PAUSE))

    def sizes(self) -> dict[str, int]:
        """Bytes of each file: of one, of a folder's, or of those that a star in the last name fits. Names that begin with a
        dot or an underscore are no data."""
        system, path = opened(self.path)
        if "*" in path:
            folder, name = path.rsplit("/", 1)
            head, tail = name.split("*", 1)
            found = [i for i in system.get_file_info(fs.FileSelector(folder)) if i.base_name.startswith(head) and i.base_name.endswith(tail)]
        else:
            info = system.get_file_info(path)
            found = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        return {i.path: i.size for i in sorted(found, key=lambda i: i.path) if i.is_file and i.base_name[0] not in "._"}

    def opened(self, path: str) -> ResumedFile:
        return ResumedFile(opened(self.path)[0], path, 0, self.retries, self.pause)

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, stop in sorted(end.items()):
            first = start.get(path, 0)
            out += [LineRange(path, at, min(at + self.bytes, stop), stop) for at in range(first, stop, self.bytes)]
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read is asked for once all the same
            return
        file, held, size = self.opened(partition.path), [], 0
        try:
            for at, line in lines_of(file, partition):
                held.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                size += len(line) + 16
                if size >= STEP:
                    yield self._batch(partition.path, held)
                    held, size = [], 0
            yield self._batch(partition.path, held)
        finally:
            file.close()

    @staticmethod
    def _batch(path: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
        columns = [pa.array([path] * len(held), pa.string()), pa.array([a for a, _ in held], pa.int64()), pa.array([v for _, v in held], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "at", "value"])


class LinesReader(_Lines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.ranges({}, self.sizes())


class LinesStreamReader(_Lines, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """The driver looks for the last break of each file that has grown since it last looked; it reads no more of it.
        Files that are gone keep their offset."""
        now = dict(self.seen)
        for path, size in self.sizes().items():
            known = now.get(path, 0)
            if size < known:
                raise OSError(f"{path} has {size} bytes, but {known} were read")
            if size > known:
                file = self.opened(path)
                try:
                    now[path] = whole_lines(file, size, known)
                finally:
                    file.close()
        self.seen = now
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # After a restart the offsets come from the checkpoint. A file of them that is gone since keeps its place.
        self.seen = {**end["files"], **self.seen}
        for path, first in start["files"].items():
            if end["files"].get(path, first) < first:
                raise OSError(f"{path} is shorter than the {first} bytes that were read")
        return self.ranges(start["files"], end["files"])


class ResumableLines(DataSource):
    """Options: ``path`` (a file, a folder, or one with a star in its name), ``partitionBytes``, ``retries``, ``pause``."""

    @classmethod
    def name(cls) -> str:
        return "resumable_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> LinesStreamReader:
        return LinesStreamReader(self.options)


def read_json_lines_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream ``file, at, text, source, kind`` of JSON lines; a missing kind is prose, lines without a text are left out."""
    spark.dataSource.register(ResumableLines)
    lines = spark.readStream.format("resumable_lines").options(**{k: str(v) for k, v in options.items()}).load(path)
    rows = lines.select("file", "at", F.from_json("value", "text string, source string, kind string").alias("row"))
    return rows.where("row.text <> ''").select("file", "at", "row.text", "row.source", F.coalesce("row.kind", F.lit("prose")).alias("kind"))

"""Greedy near-duplicate removal over a stream of documents: what ``dedup.greedy_duplicates`` drops, as documents arrive.

Two stateful operators talk to each other. The first one is keyed by bucket (band and key). It holds the bucket's owner,
the earliest kept document there, or, as long as there is none, the documents that wait for it. A document gets one answer
from each of its buckets: that it resembles the owner, that it doesn't, or that nobody is before it. The second operator is
keyed by document and settles it: dropped at the first resemblance, kept when all its buckets have answered without one. Its
decisions are the query's output, and this output is a source of the same query: a bucket whose first document was kept
has an owner, one whose first document was dropped goes on to the next. So a chain of documents that hang on each other
takes a micro-batch a link, and a bucket's state shrinks to its owner as soon as that is known.

Order is that of arrival in micro-batches and of ``id`` inside one. Both states live in the state store. Each micro-batch
writes its decisions to a folder of its number, over what a failed attempt may have left there, and the next one is planned
only after that; so a query that is started again from its checkpoint goes on where it was. A micro-batch without decisions
leaves no folder, or it would call for another one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import dedup

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "id long, sig array<bigint>, kept boolean"


class BucketOwner(StatefulProcessor):
    """Answers of one bucket: (id, sig, resembles) rows, one for each document that comes here."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "id long, sig array<bigint>")
        self.waiting = handle.getMapState("waiting", "id long", "batch long, sig array<bigint>, answered boolean")
        self.batches = handle.getValueState("batches", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived, settled = [], {}
        for pdf in rows:
            for i, sig, kept in zip(pdf["id"], pdf["sig"], pdf["kept"], strict=True):
                if kept is None or pd.isna(kept):
                    arrived.append((int(i), [int(x) for x in sig]))
                else:
                    settled[int(i)] = bool(kept)
        out: list[tuple[int, list[int], bool]] = []
        if self.owner.exists():
            self._compare(self.owner.get()[1], arrived, out)
        else:
            self._wait(arrived, settled, out)
        if out:
            yield pd.DataFrame({"id": [i for i, _, _ in out], "sig": [s for _, s, _ in out], "resembles": [x for _, _, x in out]})

    def _compare(self, owner: list[int], rows: list[tuple[int, list[int]]], out: list) -> None:
        mine = np.array(owner)
        out.extend((i, sig, bool((np.array(sig) == mine).mean() >= self.threshold)) for i, sig in sorted(rows))

    def _wait(self, arrived: list, settled: dict[int, bool], out: list) -> None:
        """No owner yet: the first one that waits is answered, and owns the bucket once it is kept."""
        batch = (self.batches.get()[0] if self.batches.exists() else 0) + 1
        queue = {int(k[0]): (int(v[0]), [int(x) for x in v[1]], bool(v[2])) for k, v in self.waiting.iterator()} if batch > 1 else {}
        for i, kept in settled.items():
            if i in queue and not kept:
                if not queue[i][2]:  # it needs no answer any more, but is owed one
                    out.append((i, queue[i][1], False))
                del queue[i]
                self.waiting.removeKey((i,))
        owner = next((i for i, kept in settled.items() if kept and i in queue), None)
        if owner is not None:
            sig = queue.pop(owner)[1]
            self.owner.update((owner, sig))
            self.waiting.clear()
            self.batches.clear()
            self._compare(sig, [(i, s) for i, (_, s, answered) in queue.items() if not answered] + arrived, out)
            return
        for i, sig in arrived:
            queue[i] = (batch, sig, False)
            self.waiting.updateValue((i,), queue[i])
        self.batches.update((batch,))
        if queue:
            first = min(queue, key=lambda i: (queue[i][0], i))
            if not queue[first][2]:
                out.append((first, queue[first][1], False))
                self.waiting.updateValue((first,), (*queue[first][:2], True))

    def close(self) -> None:
        pass


class Settle(StatefulProcessor):
    """One decision a document out of its buckets' answers; its state goes with the last of them."""

    def __init__(self, n_bands: int):
        self.n_bands = n_bands

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answers = handle.getValueState("answers", "n int, dropped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, dropped = self.answers.get() if self.answers.exists() else (0, False)
        before, sig = dropped, None
        for pdf in rows:
            n += len(pdf)
            dropped = dropped or bool(pdf["resembles"].any())
            sig = pdf["sig"].iloc[0]
        if n >= self.n_bands:
            self.answers.clear()
        else:
            self.answers.update((n, dropped))
        if (dropped and not before) or (n >= self.n_bands and not dropped):
            yield pd.DataFrame({"id": [key[0]], "sig": [sig], "kept": [not dropped]})

    def close(self) -> None:
        pass


def _folder(spark: SparkSession, path: str):
    """A path and its file system, by Hadoop."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder


def write_decisions(settled: DataFrame, decisions: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Starts the query whose output ``settled`` reads."""
    def write(rows: DataFrame, batch: int) -> None:
        path = f"{decisions}/b-{batch:012d}"
        rows.write.mode("overwrite").parquet(path)
        if rows.sparkSession.read.schema(DECISIONS).parquet(path).isEmpty():
            files, folder = _folder(rows.sparkSession, path)
            files.delete(folder, True)

    return settled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).outputMode("append").start()


def settle_stream(signed: DataFrame, decisions: str, n_bands: int, rows: int, threshold: float) -> DataFrame:
    """``id, sig, kept`` for every document of the stream ``signed`` (``id, sig``), given the folder to which a query
    writes these very rows. Ids are unique; a null id is an error of the source and is left out."""
    spark = signed.sparkSession
    files, folder = _folder(spark, decisions)
    files.mkdirs(folder)  # read as a stream before anything is in it
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # states of this kind know no other store
    arrived = signed.where("id is not null").select(F.col("id").cast("long").alias("id"), "sig", F.lit(None).cast("boolean").alias("kept"))
    told = spark.readStream.schema(DECISIONS).option("recursiveFileLookup", "true").parquet(decisions)
    # A key of the state store is a string: the slice itself, so no two keys collide.
    spelled = F.transform("sig", lambda x: x.cast("string"))
    slices = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.array_join(F.slice(spelled, b * rows + 1, rows), ","))
    events = arrived.unionByName(told).select("id", "sig", "kept", F.posexplode(slices).alias("band", "key"))
    answers = events.groupBy("band", "key").transformWithStateInPandas(BucketOwner(threshold), "id long, sig array<bigint>, resembles boolean", "append", "none")
    return answers.groupBy("id").transformWithStateInPandas(Settle(n_bands), DECISIONS, "append", "none")


def start_greedy_dedup(docs: DataFrame, decisions: str, checkpoint: str, num_perm: int = 128, threshold: float = 0.8, k: int = 5, seed: int = 1, id_col: str = "doc_id", **options: str) -> StreamingQuery:
    """Starts the query over a stream of documents; ``decisions`` and ``checkpoint`` are folders all executors share.

    Null and empty texts have the signature of no shingle, as in the batch operator, so all but the first resemble it."""
    n_bands, rows = dedup.optimal_bands(num_perm, threshold)
    signed = dedup.signatures_blake2b(docs, num_perm, k, seed, id_col).withColumnRenamed(id_col, "id")
    settled = settle_stream(signed, decisions, n_bands, rows, threshold)
    return write_decisions(settled, decisions, checkpoint, **options)


def decided(spark: SparkSession, decisions: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, kept`` of all documents settled so far."""
    return spark.read.schema(DECISIONS).option("recursiveFileLookup", "true").parquet(decisions).select(F.col("id").alias(id_col), "kept")

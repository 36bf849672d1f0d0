"""Quality classification of documents by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE_BYTES`` bytes, cut at line or word ends; every passage of the whole
text is encoded as a vector: shares of byte classes, of class pairs and of classes on both sides of a gap between words,
word statistics, and hashed words, pairs of neighbouring words and pairs of letters. With h the hidden encoding of a
passage,

    h_k = tanh(A x_k),   a = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),   z = sum_k a_k h_k,   p = sigmoid(c . z + b)

The gated attention weights are learned from document labels alone, by Adam on whole bags: all passages of a training
document train. Damaged copies of good training documents (words shuffled, or every letter replaced at random) train as
bad ones, so that good means the words and their order, not only the look of the marks."""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import buffers, drop_table, materialize, smallest_by_hash, spread, text_slices

PASSAGE_BYTES = 512
#: Bound of the training sample: labelled documents, those whose id hashes lowest. All their passages train, however many.
TRAIN_DOCUMENTS = 6000
#: Bags of a chunk of the training table, and bytes of bags that the driver holds before they go to a file of its own.
CHUNK_BAGS, HELD_BYTES = 1024, 4 << 20
#: One good training document in so many is damaged in each of the two ways.
DAMAGED = 6
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 24, 12, 16, 8e-3, 1e-4
#: Places that words, word pairs and letter pairs are hashed to.
PLACES = 256

#: Byte classes: each mark that junk repeats has its own.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "#$%&*@^~+=", "-_/\\:;", "'\"()[]{}<>"]
CLASS = np.full(256, len(_CLASSES), dtype=np.int64)  # control characters and the like
for _i, _members in enumerate(_CLASSES):
    CLASS[[ord(c) for c in _members]] = _i
CLASS[0x80:] = len(_CLASSES) + 1  # parts of characters outside ASCII
N_CLASSES = len(_CLASSES) + 2
FEATURES = N_CLASSES + 2 * N_CLASSES**2 + 6 + 3 * PLACES


def passages(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of passages: every document is cut behind the first white space after each PASSAGE_BYTES bytes (or hard
    after twice as many); an empty one is one empty passage. Returns starts, and the first passage of each document."""
    gaps = np.flatnonzero(tv.SEPARATOR[data])
    starts, first = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = max(1, -(-(b - a) // PASSAGE_BYTES))
        cuts = a + PASSAGE_BYTES * np.arange(n, dtype=np.int64)
        if n > 1:
            at = np.searchsorted(gaps, cuts[1:])
            soft = np.where(at < len(gaps), gaps[np.minimum(at, len(gaps) - 1)] + 1, b) if len(gaps) else np.full(n - 1, b)
            cuts[1:] = np.where(soft < cuts[1:] + PASSAGE_BYTES, soft, cuts[1:])
            cuts = np.unique(cuts[cuts < b])
        starts.append(cuts)
        first.append(first[-1] + len(cuts))
    return np.concatenate([*starts, offsets[-1:]]), np.array(first)


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a batch, and the first passage of each document (n + 1 entries)."""
    if not len(offsets) - 1:
        return np.zeros((0, FEATURES), np.float32), np.zeros(1, np.int64)
    cuts, first = passages(data, offsets)
    n = len(cuts) - 1
    lengths = np.diff(cuts)
    kind = CLASS[data]
    row = np.repeat(np.arange(n, dtype=np.int64), lengths)
    single = np.bincount(row * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    same = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
    pair = np.bincount((row[:-1] * N_CLASSES**2 + kind[:-1] * N_CLASSES + kind[1:])[same] if len(row) > 1 else np.zeros(0, np.int64), minlength=n * N_CLASSES**2).reshape(n, -1)
    starts, ends, _ = tv.word_spans(data, offsets)
    words = tv.span_hashes(data, starts, ends)
    at = np.searchsorted(cuts, starts, side="right") - 1
    count = np.bincount(at, minlength=n).astype(np.float64)
    again = np.bincount(at[1:][(words[1:] == words[:-1]) & (at[1:] == at[:-1])] if len(at) > 1 else at[:0], minlength=n)
    key = np.sort(words ^ tv.mix(at.astype(np.uint64)))  # a word in a passage
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    order = np.argsort(words ^ tv.mix(at.astype(np.uint64)), kind="stable")
    distinct = np.bincount(at[order][fresh], minlength=n)
    size = np.maximum(lengths, 1)[:, None]
    some = np.maximum(count, 1)
    place = lambda h: (h >> np.uint64(40)).astype(np.int64) % PLACES
    share = lambda rows, of, width, total: np.sqrt(np.bincount(rows * width + of, minlength=n * width).reshape(n, width) / total[:, None])
    next_to = np.flatnonzero(at[1:] == at[:-1]) if len(at) > 1 else np.zeros(0, np.int64)  # words with a next one in the passage
    gaps = share(at[next_to], kind[ends[next_to] - 1] * N_CLASSES + kind[starts[next_to + 1]], N_CLASSES**2, some) if len(at) else np.zeros((n, N_CLASSES**2))
    word = share(at, place(words), PLACES, some)
    pairs = share(at[next_to], place(tv.mix(words[next_to] * np.uint64(0xD6E8FEB86659FD93) + words[next_to + 1])) if len(at) else at, PLACES, some)
    letter = kind <= 1
    letter |= data >= 0x80
    two = np.flatnonzero(letter[:-1] & letter[1:] & same) if len(row) > 1 else np.zeros(0, np.int64)
    low = np.where(kind == 1, data | 0x20, data).astype(np.int64)
    letters = share(row[two], (low[two] * 31 + low[two + 1] * 7) % PLACES if len(two) else row[two], PLACES, size[:, 0])
    more = np.stack([again / some, distinct / some, np.log1p(count) / 5, lengths / PASSAGE_BYTES / 2, np.bincount(at, weights=(ends - starts).astype(float), minlength=n) / some / 10, count == 0], axis=1)
    return np.concatenate([np.sqrt(single / size), np.sqrt(pair / size), gaps, more, word, pairs, letters], axis=1).astype(np.float32), first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    def __init__(self, mean, scale, p):
        self.mean, self.scale, self.p = mean, scale, p

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["A"] + p["a"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        starts = first[:-1]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), np.diff(first)))
        weight = e / np.repeat(np.add.reduceat(e, starts), np.diff(first))
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return x, h, t, g, weight, z, _sigmoid(z @ p["c"] + p["b"])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1]


def damage(text: str, way: int, rng: np.random.Generator) -> str:
    """A bad copy of a text: its words shuffled among its gaps (0), or every letter replaced at random (1)."""
    if way == 0:
        parts = re.split(r"(\s+)", text)
        words = [parts[2 * i] for i in rng.permutation((len(parts) + 1) // 2)]
        parts[::2] = words
        return "".join(parts)
    drawn = iter(rng.integers(0, 26, len(text)).tolist())
    return "".join(chr((65 if c.isupper() else 97) + x) if c.isalpha() else c for c, x in zip(text, drawn, strict=True))


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> AttentionModel | None:
    """From bags that are all in memory."""
    return train_chunks(lambda _: (bags, labels), 1, seed)


def train_chunks(chunk: Callable[[int], tuple[Sequence[np.ndarray], np.ndarray]], chunks: int, seed: int = 5) -> AttentionModel | None:
    """``chunk(i)`` gives bags, which may be of half precision, and their labels, the same at each call; a step takes 64 bags
    of a chunk in single precision. Each epoch takes the chunks, and the bags of each, in another order."""
    rng = np.random.default_rng(seed)
    size, count, good, mean, square = 0, 0, 0.0, 0.0, 0.0
    for i in range(chunks):
        bags, labels = chunk(i)
        count, good = count + len(bags), good + float(labels.sum())
        for b in bags:
            size += len(b)
            mean = mean + b.sum(axis=0, dtype=np.float64)
            square = square + (b.astype(np.float32) ** 2).sum(axis=0, dtype=np.float64)
    if not count:
        return None
    mean, square = mean / size, square / size
    scale = 1 / (np.sqrt(np.maximum(square - mean**2, 0)) + 0.05)
    width = len(mean)
    p = {"A": rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), "a": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": np.zeros(ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    rate = np.clip(good / count, 0.02, 0.98)
    p["b"][0] = np.log(rate / (1 - rate))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = AttentionModel(mean.astype(np.float32), scale.astype(np.float32), p)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, batch = 0, 64
    for epoch in range(EPOCHS):
        for i in rng.permutation(chunks):
            bags, labels = chunk(i)
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                some = [bags[i] for i in chosen]
                first = np.concatenate([[0], np.cumsum([len(b) for b in some])])
                x, h, t, g, weight, z, out = model.forward(np.concatenate(some).astype(np.float32), first)
                counts = np.diff(first)
                dlogit = ((out - labels[chosen]) / len(chosen)).astype(np.float32)
                dz = dlogit[:, None] * p["c"]
                dzk = np.repeat(dz, counts, axis=0)
                dh = weight[:, None] * dzk
                dweight = (dzk * h).sum(axis=1)
                de = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, first[:-1]), counts))
                dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
                dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
                grads = {"A": x.T @ dh, "a": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dlogit, "b": dlogit.sum(keepdims=True)}
                step += 1
                lr = RATE * (1 - 0.9 * epoch / EPOCHS)
                for k, d in grads.items():
                    d = d + DECAY * p[k]
                    m, v = moment[k]
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p[k] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _encode_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags of (id, text, label), and those of the damaged copies of some good documents, with a number for each copy."""
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            ids, texts, labels = (c.slice(a, b - a).to_pylist() for c in batch.columns[:3])
            ways = [0] * len(ids)
            for i, text, label in list(zip(ids, texts, labels, strict=True)):
                draw = zlib.crc32(str(i).encode()) // 7 % DAMAGED
                if label > 0 and text and draw < 2:
                    ids.append(i)
                    texts.append(damage(text, draw, np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))))
                    labels.append(0)
                    ways.append(1)
            x, first = encode_passages(*buffers(pa.array(texts, pa.string())))
            x = x.astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[f:g].tobytes() for f, g in zip(first, first[1:])], pa.binary()), pa.array(labels, pa.int32()), pa.array(ways, pa.int32())], names=["id", "bag", "label", "way"])


class _Bags(Sequence):
    """Bags of a chunk, each read from the file when it is asked for."""

    def __init__(self, file: BinaryIO, places: list[tuple[int, int]]):
        self.file, self.places = file, places

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> np.ndarray:
        at, size = self.places[i]
        self.file.seek(at)
        return np.frombuffer(self.file.read(size), dtype=np.float16).reshape(-1, FEATURES)


def _write_bags(sample: DataFrame, file: BinaryIO, chunks: int) -> list[tuple[_Bags, np.ndarray]]:
    """The chunks of a table of bags, which goes into the file a partition at a time."""
    found: list[list[tuple]] = [[] for _ in range(chunks)]
    for r in sample.select("chunk", "id", "way", "bag", "label").toLocalIterator():
        found[r["chunk"]].append((r["id"], r["way"], file.tell(), len(r["bag"]), float(r["label"] > 0)))
        file.write(r["bag"])
    return [(_Bags(file, [x[2:4] for x in sorted(rows)]), np.array([x[4] for x in sorted(rows)])) for rows in found]


def fit(docs: DataFrame, labels: DataFrame, label_col: str, train_filter, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel | None:
    """Learn from at most ``TRAIN_DOCUMENTS`` labelled documents, those whose id hashes lowest, and damaged copies of a third
    as many. Their bags are written as a table, and from there to a file of the driver, which reads a step's bags at a
    time; so its memory has a bound but for the longest texts of a partition, and no passage is left out. A document
    with several labels counts with the largest; of several rows of an id the one of the lowest text hash."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & train_filter(F.col("id")))
    chosen = materialize(smallest_by_hash(known.groupBy("id").agg(F.max("label").alias("label")), "id", TRAIN_DOCUMENTS, 11))
    chunks = -(-chosen.count() // CHUNK_BAGS)
    if not chunks:
        drop_table(chosen)
        return None
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")  # TRAIN_DOCUMENTS ids at most
    one = rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    encoded = one.mapInArrow(_encode_sample, "id long, bag binary, label int, way int")
    dealt = encoded.withColumn("chunk", F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(chunks)).cast("int"))
    sample = materialize(dealt.repartitionById(chunks, F.col("chunk")))
    with tempfile.SpooledTemporaryFile(max_size=max(HELD_BYTES, 1)) as file:
        found = _write_bags(sample, file, chunks)
        model = train_chunks(found.__getitem__, chunks)
    drop_table(sample)
    drop_table(chosen)
    return model


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            x, first = encode_passages(*buffers(batch.column(1).slice(a, b - a)))
            scores = model.score(x, first).astype(float) if model is not None else np.full(b - a, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64())], names=["id", "score"])


def _keep(batches: Iterator[pa.RecordBatch], model, least: float, column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if model.value is None:
            yield batch
            continue
        texts = batch.column(column).cast(pa.string())
        for a, b in text_slices(texts):
            x, first = encode_passages(*buffers(texts.slice(a, b - a)))
            yield batch.slice(a, b - a).filter(pa.array(model.value.score(x, first) >= least))


def keep(docs: DataFrame, model: AttentionModel | None, least: float, text_col: str = "text") -> DataFrame:
    """Rows of at least that score, with all their columns; without a model, all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES by HIDDEN floats
    return spread(docs).mapInArrow(partial(_keep, model=shared, least=least, column=docs.columns.index(text_col)), docs.schema)


def score(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` (0 to 1) for each row, in no shuffle. Null and empty texts are one empty passage and get its
    score; without any labels every score is 0.5. Repeated rows get equal scores; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES by HIDDEN floats
    wanted = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return wanted.mapInArrow(partial(_score, model=shared), "id long, score double").withColumnRenamed("id", id_col)

"""Language identification with blended-spectrum presence kernels.

Two texts are as alike as the number of character n-grams (n = 1 to 3) that occur in both, over the root of the product
of how many occur in each. Kernel ridge regression, one language against the rest, runs on ``LANDMARKS`` landmark texts
(Nystroem): with K the kernel among landmarks and Z = K(texts, landmarks) K^(-1/2), the weights are those of a ridge
regression on Z. Texts are scored in batches by two matrix products: presence by landmarks, then landmarks by languages.

N-grams are hashed into ``BUCKETS`` places, so every presence set is a row of bits of a fixed size.

A share of the margin can't say "none of them". Whether a language claims a text at all is told by its nearest landmark:
the n-grams that both have, less those that texts of their sizes share by chance, over the most that they could share
less the same. That is 0 for strange texts and near 1 for known ones, whatever their lengths; the bound of a language is
learned on its training rows, each of which is compared with the landmarks but itself."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lowest_hashes, spread, text_slices

BUCKETS = 4096
#: Landmarks at least, and of each language.
LANDMARKS, LANGUAGE_LANDMARKS = 128, 8
#: Bound of the training sample: texts of a language. Every language that any row has is learned.
TEXTS_PER_LANGUAGE = 300
RIDGE = 1e-2
#: Sharpness of the score: margins of the regression become shares by a softmax.
SHARPNESS = 6.0
UNKNOWN = "und"
#: A language claims what is as near to a landmark as CLAIM times the CLAIM_QUANTILE of its training rows.
CLAIM, CLAIM_QUANTILE = 0.85, 0.01
#: Characters of the pieces whose nearness is averaged, so that long texts don't fill their rows, and pieces at a time.
PIECE, PIECES = 1024, 1024


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each framed by blanks, and the offsets."""
    framed = [" " + t.lower() + " " for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in framed])]).astype(np.int64)
    return np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offsets


def presence(texts: list[str]) -> np.ndarray:
    """A row of booleans for each text: which n-gram places occur in it."""
    chars, offsets = _characters(texts)
    out = np.zeros((len(texts), BUCKETS), dtype=bool)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, np.diff(offsets))
    h = chars * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in (1, 2, 3):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + chars[n - 1 :] * np.uint32(0xC2B2AE35)
        # An n-gram that would reach into the next text is left out.
        inside = row[: len(h)] == row[n - 1 :] if n > 1 else slice(None)
        flat[row[: len(h)][inside] + (h[inside] * np.uint32(0x27D4EB2F) >> shift)] = True
    return out


class KernelModel:
    def __init__(self, languages: list[str], landmarks: np.ndarray, norms: np.ndarray, weights: np.ndarray, bias: np.ndarray, bounds: np.ndarray):
        self.languages, self.landmarks, self.norms, self.weights, self.bias, self.bounds = languages, landmarks, norms, weights, bias, bounds

    @staticmethod
    def kernel(rows: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(rows.sum(axis=1), 1, dtype=np.float32))
        return (rows.astype(np.float32) @ landmarks.T) / (sizes[:, None] * norms[None, :])

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(presence(texts), self.landmarks, self.norms) @ self.weights + self.bias

    def nearness(self, texts: list[str]) -> np.ndarray:
        """To the nearest landmark, the mean over the pieces of each text."""
        pieces = [(i, t[a : a + PIECE]) for i, t in enumerate(texts) for a in range(0, max(len(t), 1), PIECE)]
        total = np.zeros(len(texts))
        for a in range(0, len(pieces), PIECES):
            part = pieces[a : a + PIECES]
            np.add.at(total, [i for i, _ in part], overlap(presence([t for _, t in part]), self.landmarks).max(axis=1))
        return total / np.bincount([i for i, _ in pieces], minlength=len(texts))


def overlap(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared places beyond chance, as a part of the most possible; 0 where rows are too full to tell."""
    n, m = rows.sum(axis=1, dtype=np.float32)[:, None], landmarks.sum(axis=1, dtype=np.float32)[None, :]
    most, chance = np.minimum(n, m), n * m / BUCKETS
    known = most - chance > most / 8
    return np.where(known, (rows.astype(np.float32) @ landmarks.T - chance) / np.where(known, most - chance, 1), 0)


def train(bits: np.ndarray, labels: list[str], landmarks: int | None = None, ridge: float = RIDGE) -> KernelModel | None:
    """``bits`` are presence rows; landmarks are taken in turn from each language."""
    languages = sorted(set(labels))
    if not languages:
        return None
    landmarks = max(LANDMARKS, LANGUAGE_LANDMARKS * len(languages)) if landmarks is None else landmarks
    y = np.array([languages.index(x) for x in labels])
    by = [np.flatnonzero(y == c) for c in range(len(languages))]
    chosen = [x[i] for i in range(max(map(len, by))) for x in by if i < len(x)][:landmarks]
    marks = bits[chosen].astype(np.float32)
    norms = np.sqrt(np.maximum(marks.sum(axis=1), 1)).astype(np.float32)
    values, vectors = np.linalg.eigh(KernelModel.kernel(bits[chosen], marks, norms).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = KernelModel.kernel(bits, marks, norms).astype(np.float64) @ root
    targets = np.where(y[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    # Each language weighs the same, however many texts it has.
    share = 1.0 / np.array([len(by[c]) for c in y])
    share /= share.mean()
    mean = np.average(z, axis=0, weights=share)
    level = np.average(targets, axis=0, weights=share)
    centred = z - mean
    w = np.linalg.solve(centred.T @ (centred * share[:, None]) + ridge * len(z) / len(languages) * np.eye(z.shape[1]) * 0.1, centred.T @ ((targets - level) * share[:, None]))
    near = overlap(bits, marks)
    near[chosen, np.arange(len(chosen))] = 0  # a landmark is not compared with itself
    near = near.max(axis=1)
    bounds = np.array([CLAIM * np.quantile(near[x], CLAIM_QUANTILE) for x in by])
    return KernelModel(languages, marks, norms, (root @ w).astype(np.float32), (level - mean @ w).astype(np.float32), bounds)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(0)):
            part = batch.slice(a, b - a)
            rows = presence([t or "" for t in part.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(r).tobytes() for r in rows], pa.binary()), part.column(1), part.column(2)], names=["bits", "lang", "h"])


def fit(docs: DataFrame, train_filter, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """Learn from at most ``TEXTS_PER_LANGUAGE`` rows of each language, those whose id and text hash lowest; repeated rows
    count once. Only their presence bits (``BUCKETS / 8`` bytes a row) reach the driver."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & train_filter(F.col("id")))
    hashed = rows.select("text", "lang", F.xxhash64(F.lit(7), "id", "text").alias("h"))
    common = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()  # a row a language
    if not common:
        return None
    # Only hashes among which twice as many rows as wanted are expected are ranked, however many rows a language has; the
    # least hash is always among them, also where all rows of a language are alike.
    bounds = [(r["lang"], max(lowest_hashes(2 * TEXTS_PER_LANGUAGE, r["n"]), r["least"])) for r in common]
    low = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, low long"))  # a row a language
    few = hashed.join(low, "lang").where("h <= low").select("text", "lang", "h").mapInArrow(_bits, "bits binary, lang string, h long").dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    sample = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= TEXTS_PER_LANGUAGE).select("bits", "lang").collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    sample = [sample[i] for i in np.random.default_rng(3).permutation(len(sample))]
    bits = np.array([np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8)) for r in sample], dtype=bool)
    return train(bits, [r["lang"] for r in sample])


def predict(texts: list[str], model: KernelModel | None) -> tuple[list[str], np.ndarray]:
    languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    # A letter is whatever the Unicode standard calls one.
    lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
    if model is not None and lettered:
        margins = model.scores([texts[i] for i in lettered])
        shares = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
        shares /= shares.sum(axis=1, keepdims=True)
        for i, k, s in zip(lettered, margins.argmax(axis=1), shares.max(axis=1), strict=True):
            languages[i], scores[i] = model.languages[k], float(s)
    return languages, scores


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            part = batch.slice(a, b - a)
            languages, scores = predict([t or "" for t in part.column(1).to_pylist()], model.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])


def _keep(batches: Iterator[pa.RecordBatch], model, least: float, column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(column).cast(pa.string())):
            part = batch.slice(a, b - a)
            texts = [t or "" for t in part.column(column).cast(pa.string()).to_pylist()]
            languages, scores = predict(texts, model.value)
            yield part.filter(pa.array(claimed(texts, languages, model.value) & (scores >= least)))


def claimed(texts: list[str], languages: list[str], model: KernelModel) -> np.ndarray:
    """Whether each text is as near to what was learned as its predicted language asks for; ``und`` never is."""
    bound = {UNKNOWN: np.inf} | dict(zip(model.languages, model.bounds.tolist(), strict=True))
    return model.nearness(texts) >= np.array([bound[x] for x in languages])


def keep(docs: DataFrame, model: KernelModel | None, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """Rows that a learned language claims, with at least that score and with all their columns; without a model, all
    rows. Null and empty texts and texts without a letter go; repeated rows stay or go together."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return spread(docs).mapInArrow(partial(_keep, model=shared, least=least, column=docs.columns.index(text_col)), docs.schema)


def identify(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for each row, in no shuffle. ``und`` with score 0 where the text is null or has no
    letter, or nothing was learned; the score is the share of the language's margin in a softmax. Ties go to the first
    language in order of name. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks by BUCKETS floats, and the landmarks of a language are bounded
    wanted = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return wanted.mapInArrow(partial(_score, model=shared), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)

"""Order-preserving packing of documents into training sequences, by dynamic programming over cut places.

Documents follow each other in the order of their ids, in as many ranges of ids as the amount of text asks for, however
many cores or input files there are. Cut places are ends of documents and sentences (and, inside
a sentence longer than ``LONG_GAP`` tokens, every ``HARD_STEP`` tokens). With p the token position of a place and f the
least cost of packing all before it,

    f(j) = penalty(j) + min( min over i with p_j - p_i <= length of f(i) + length - (p_j - p_i),
                             min over the short lengths w with p_i = p_j - w of f(i) )  + 1

The first minimum slides over f(i) + p_i, so a monotone queue gives it in constant time; the second is a look-up, for a
window as long as a power of two is not padded. The cost is padding plus truncation penalties plus one a window.

The program runs over segments of a bounded number of tokens; what the last window of a segment would leave open is
carried into the next one. The last segment of a range runs to its end, where shorter powers of two are allowed as well.
Dealing the rows out to ranges is the only shuffle of texts. Bounds of ranges are quantiles of the keys whose hash is low,
so the result is a function of the table: Spark's own range partitioning would draw others for each action."""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ALPHABET, tokenizer_path
from .common import lowest_hashes, text_slices

LENGTH = 2048
SEGMENT_TOKENS = 1 << 19
#: Lengths below the full one that need no padding and that a window inside a partition may have.
SHORT = (1024, 512)
#: And those that a window near the end of a range may have besides.
LAST_SHORT = (256, 128, 64, 32, 16, 8, 4, 2, 1)
PENALTY_SENTENCE, PENALTY_HARD, PENALTY_WINDOW = 2, 64, 1
LONG_GAP, HARD_STEP = 256, 64
#: Keys that a range's bound is drawn from, and of all ranges together (24 bytes each on the driver).
RANGE_SAMPLE, MOST_SAMPLED = 128, 1 << 20
_RUN = re.compile(r"\s\s")


#: Pre-tokens of byte-level BPE (fixed value); the second form is for texts without two white-space characters in a row,
#: where the look-ahead has nothing to decide and a faster engine does.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIMPLE_PATTERN = PATTERN.replace(r"\s+(?!\S)|", "")


class ByteCodec:
    """Ids of a byte-level BPE file, and where sentences end among them."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(ALPHABET)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.simple = tiktoken.Encoding("simple", pat_str=SIMPLE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: Whether a sentence can end after a token: a full stop, a mark or a line break.
        self.closes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, dtype=bool)
        for t, i in ranks.items():
            self.closes[i] = t[-1:] in b".!?\n"

    def _plain(self, text: str) -> np.ndarray:
        engine = self.full if _RUN.search(text) else self.simple
        return np.array(engine.encode_ordinary(text), dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if self.special_pattern is not None and "<" in text and self.special_pattern.search(text):
            parts = self.special_pattern.split(text)
            return np.concatenate([np.array([self.special[x]], dtype=np.uint32) if i % 2 else self._plain(x) for i, x in enumerate(parts)])
        return self._plain(text)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Token positions after which a sentence ends; of several closing tokens in a row the last counts."""
        closing = self.closes[ids]
        closing[:-1] &= ~closing[1:]
        return np.flatnonzero(closing) + 1


@lru_cache(maxsize=2)
def byte_codec(name_or_path: str) -> ByteCodec:
    return ByteCodec(tokenizer_path(name_or_path))


def cut_places(sentence_ends: np.ndarray, document_ends: np.ndarray, last: bool = False) -> tuple[list[int], list[int]]:
    """Sorted cut positions (0 first) and their penalties; before the last end there are some for every short window."""
    places = np.union1d(sentence_ends, document_ends)
    places = np.concatenate([[0], places[places > 0]])
    gaps = np.flatnonzero(np.diff(places) > LONG_GAP)
    hard = [np.arange(places[g] + HARD_STEP, places[g + 1], HARD_STEP) for g in gaps]
    if last and len(document_ends):
        # A rest of any length is a sum of powers of two; the places are those where its summands meet.
        rests = np.concatenate([places[-1] - np.cumsum([w for w in (*SHORT, *LAST_SHORT)][::-1]), places[-1] - np.array([*SHORT, *LAST_SHORT])])
        hard.append(np.setdiff1d(rests[rests > 0], np.concatenate([places, *hard])))
    soft = np.full(len(places), PENALTY_WINDOW + PENALTY_SENTENCE)
    soft[np.searchsorted(places, document_ends)] = PENALTY_WINDOW
    soft[0] = 0
    if hard:
        more = np.concatenate(hard)
        order = np.argsort(np.concatenate([places, more]), kind="stable")
        return np.concatenate([places, more])[order].tolist(), np.concatenate([soft, np.full(len(more), PENALTY_WINDOW + PENALTY_HARD)])[order].tolist()
    return places.tolist(), soft.tolist()


def window_cuts(places: list[int], penalties: list[int], length: int, last: bool, short: tuple[int, ...] = SHORT) -> list[int]:
    """Ends of the cheapest windows over the places; unless it is the last segment, the end is one of the places in the
    last ``length`` tokens, whichever costs least a token. ``short`` are lengths that need no padding."""
    n = len(places)
    cost, came = [0] * n, [0] * n
    where = np.array(places)
    jumps = []  # for each short length, the place exactly so far back, or -1
    for w in short:
        if w < length:
            i = np.searchsorted(where, where - w)
            jumps.append(np.where(where[np.minimum(i, n - 1)] == where - w, i, -1))
    jump = np.max(jumps, axis=0).tolist() if jumps else [-1] * n
    several = [x.tolist() for x in jumps] if len(jumps) > 1 else []
    # The monotone queue: keys f(i) + p_i rise, positions rise.
    keys, nodes, spots = deque([0]), deque([0]), deque([0])
    for j in range(1, n):
        p = places[j]
        low = p - length
        while spots[0] < low:
            spots.popleft(), keys.popleft(), nodes.popleft()
        best, from_ = keys[0] - low, nodes[0]
        if jump[j] >= 0:
            for i in [x[j] for x in several] if several else [jump[j]]:
                if i >= 0 and cost[i] < best:
                    best, from_ = cost[i], i
        best += penalties[j]
        cost[j], came[j] = best, from_
        key = best + p
        while keys and keys[-1] >= key:
            keys.pop(), nodes.pop(), spots.pop()
        keys.append(key)
        nodes.append(j)
        spots.append(p)
    end = len(places) - 1
    if not last:
        tail = [j for j in range(end, 0, -1) if places[j] > places[end] - length]
        end = min(tail, key=lambda j: (cost[j] / places[j], -places[j]), default=end)
    cuts = []
    while end:
        cuts.append(places[end])
        end = came[end]
    return cuts[::-1]


_PIECE = "id long, start long, length long, ids binary, tokens long, sequence long, place long"


class _Packer:
    """Windows of one range of documents; numbers of sequences start at the range's number times 2^40."""

    def __init__(self, length: int, range_: int):
        self.length, self.range = length, range_
        self.sequence = range_ << 40
        self.docs: list[list] = []  # [id, start, ids, tokens of the document, sentence ends]
        self.tokens = 0

    def add(self, id_, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append([id_, 0, ids.tobytes(), len(ids), ends])
        self.tokens += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all windows that are settled; of the last segment, all."""
        if not self.docs:
            return []
        sizes = np.array([len(d[2]) // 4 for d in self.docs], dtype=np.int64)
        stops = np.cumsum(sizes)
        marks = [d[4] - d[1] + stop - size for d, stop, size in zip(self.docs, stops, sizes, strict=True)]
        marks = np.concatenate([m[(m > stop - size)] for m, stop, size in zip(marks, stops, sizes, strict=True)]) if marks else np.zeros(0, np.int64)
        cuts = window_cuts(*cut_places(marks, stops, last), self.length, last, (*SHORT, *LAST_SHORT) if last else SHORT)
        out, k, at = [], 0, 0
        for cut in cuts:
            place = 0
            while at < cut:
                id_, start, ids, total, _ = self.docs[k]
                inside = int(at - (stops[k] - sizes[k]))
                n = int(min(cut, stops[k]) - at)
                out.append((id_, start + inside, n, ids[4 * inside : 4 * (inside + n)], total, self.sequence, place))
                place += n
                at += n
                if at == stops[k]:
                    k += 1
            self.sequence += 1
        rest = self.docs[k:]
        if rest and at > stops[k] - sizes[k]:
            inside = int(at - (stops[k] - sizes[k]))
            rest[0][1] += inside
            rest[0][2] = rest[0][2][4 * inside :]
        self.docs, self.tokens = rest, self.tokens - int(at)
        return out


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Pieces of rows of ``range, id, text`` that are sorted by range; a range is never dealt to two tasks."""
    coder, packer = byte_codec(tokenizer), None
    end = np.array([end_id], dtype=np.uint32)
    names = ["id", "start", "length", "ids", "tokens", "sequence", "place"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for a, b in text_slices(batch.column(2), 1 << 22):
            for range_, id_, text in zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns[:3]), strict=True):
                if packer is None or packer.range != range_:
                    if packer is not None and (rows := packer.flush(True)):
                        yield batch_of(rows)
                    packer = _Packer(length, range_)
                ids = coder.encode(text or "")
                packer.add(id_, np.concatenate([ids, end]), coder.sentence_ends(ids))
                if packer.tokens >= SEGMENT_TOKENS and (rows := packer.flush(False)):
                    yield batch_of(rows)
    if packer is not None and (rows := packer.flush(True)):
        yield batch_of(rows)


def partitions_for(size: int) -> int:
    """Ranges for so many bytes of text: 9 for 25 MB, 64 for 0.5 GB, 965 for 30 GB, 215,000 of some 460 MB for 100 TB."""
    return max(1, math.ceil((size / 1e6) ** (2 / 3)))


def range_bounds(keys: DataFrame, rows: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """First keys ``(id, h)`` of all ranges but the first, by a rule on the table alone.

    Keys whose hash is low, RANGE_SAMPLE a range and at most MOST_SAMPLED in all, are counted and sorted; the bounds are
    their quantiles. Neither the session, the order of the rows nor their partitions have a say in them."""
    low = lowest_hashes(min(RANGE_SAMPLE * parts, MOST_SAMPLED), rows)
    sample = keys.where(F.xxhash64(F.lit(13), "id", "h") <= low).groupBy("id", "h").agg(F.count("*").alias("n")).toArrow()
    ids, hashes, counts = (np.asarray(c.combine_chunks(), dtype=np.int64) for c in (sample["id"], sample["h"], sample["n"]))
    order = np.lexsort((hashes, ids))
    before = np.cumsum(counts[order]) - counts[order]
    at = np.unique(np.searchsorted(before, counts.sum() * np.arange(1, parts) / parts))
    at = order[at[(at > 0) & (at < len(order))]]
    return ids[at], hashes[at]


def range_of(ids: np.ndarray, hashes: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the sorted bounds are no greater than each key."""
    low, high = np.searchsorted(bounds[0], ids), np.searchsorted(bounds[0], ids, side="right")
    out = low.copy()
    met = np.flatnonzero(high > low)  # keys whose id is that of a bound: the hashes decide
    for id_ in np.unique(ids[met]):
        rows = met[ids[met] == id_]
        a, b = low[rows[0]], high[rows[0]]
        out[rows] = a + np.searchsorted(bounds[1][a:b], hashes[rows], side="right")
    return out


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, ``start`` (tokens of the document before it), ``length``, ``ids`` (unsigned
    little-endian 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence.

    The result is a function of the table: any two actions, sessions, numbers of cores or orders of the rows give the
    same pieces. A document is its ids and then ``end_id``, so a null or empty text is one token. Order is that of the
    ids (null ids first, as if they were -2^63), then of a hash of the texts; a sequence never spans two ranges, and its
    id holds the range's number. A sequence that is as long as a power of two needs no padding, any other is to be padded to ``length``. Repeated rows
    are packed each; an empty table has no pieces. Other columns are not read.
    """
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    wanted = docs.select(id_.alias("id"), text.alias("text"))
    size, rows = wanted.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = partitions_for(size or 0)
    # The second key spreads an id that many rows have; ties are equal rows.
    keyed = wanted.select("id", "text", F.coalesce("id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("h"))
    if parts > 1:
        bounds = docs.sparkSession.sparkContext.broadcast(range_bounds(keyed.select(F.col("key").alias("id"), "h"), rows, parts))  # two numbers a range

        @F.pandas_udf("int")
        def range_number(key: pd.Series, h: pd.Series) -> pd.Series:
            return pd.Series(range_of(key.to_numpy(), h.to_numpy(), bounds.value).astype(np.int32))

        keyed = keyed.withColumn("range", range_number("key", "h"))
    else:
        keyed = keyed.withColumn("range", F.lit(0))
    dealt = keyed.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "key", "h", "text").select("range", "id", "text")
    out = dealt.mapInArrow(partial(_pack, tokenizer=tokenizer, length=length, end_id=end_id), _PIECE)
    return out.select(F.col("id").alias(id_col), "start", "length", "ids", F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"))

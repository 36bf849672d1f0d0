"""Byte-level BPE: words are counted and merges found in Spark, texts are encoded by Arrow UDFs or by a dictionary table."""

from __future__ import annotations

import heapq
import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from ..sources.checkpoint import drop_table, materialize
from . import bpe_training

# Fixed value: the published pre-token pattern of byte-level BPE.
PRETOKEN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of what a tokenizer remembers: words, and characters of a word; longer words than LONG bytes are merged by heap.
CACHE_WORDS, CACHE_LENGTH, LONG = 150_000, 64, 1024
#: Words merged at once, and characters of texts, or ids, that one step works on (one longer text is a step of its own).
BLOCK_WORDS, SLICE = 16_384, 1 << 19
#: A pre-token with more than 1 / HOT_SHARE of all occurrences is joined by SALTS keys.
HOT_SHARE, SALTS = 1024, 64


def pretoken_counts(docs: DataFrame) -> DataFrame:
    tokens = docs.select(F.explode_outer(F.regexp_extract_all("text", F.lit(PRETOKEN), F.lit(0))).alias("pretoken"))
    return tokens.where("pretoken is not null").groupBy("pretoken").agg(F.count("*").alias("n"))


class Tokenizer:
    """Vocabulary: special tokens, the 256 bytes, then one entry for each merge."""

    def __init__(self, merges: list[tuple[int, int]], special: list[str]):
        self.special, self.merges = list(special), [tuple(m) for m in merges]
        base = len(self.special)
        self.pieces: list[bytes] = [s.encode() for s in self.special] + [bytes([b]) for b in range(256)]
        for a, b in self.merges:
            self.pieces.append(self.pieces[a] + self.pieces[b])
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in self.pieces])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.rank = {m: i for i, m in enumerate(self.merges)}
        self.base = base
        self.cache: dict[str, bytes] = {}
        self.pattern = regex.compile(PRETOKEN)

    @property
    def vocab_size(self) -> int:
        return len(self.pieces)

    def token_id(self, token: str) -> int:
        """Id of a special token or of an entry's text; KeyError if there is none."""
        if token in self.special:
            return self.special.index(token)
        try:
            return self.pieces.index(token.encode("utf-8"), self.base)
        except ValueError:
            raise KeyError(token) from None

    def _word(self, word: str) -> list[int]:
        """Merges in order of rank, then of place: a heap over the pairs of a linked list, n log n for a word of n bytes."""
        ids = [self.base + b for b in word.encode("utf-8")]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != self.merges[rank]:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self.base + 256 + rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.rank.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: the words that no text before had are merged all at once, then put together by place."""
        cut = [self.pattern.findall(t) for t in texts]
        new: set[str] = set()
        for words in cut:
            new.update(filterfalse(self.cache.__contains__, words))
        data = {w: w.encode("utf-8") for w in new}
        short = [w for w in new if len(data[w]) <= LONG]
        for at in range(0, len(short), BLOCK_WORDS):
            block = short[at : at + BLOCK_WORDS]
            for word, ids in zip(block, bpe_training.encode_words([data[w] for w in block], self.merges, self.base), strict=True):
                self.cache[word] = ids.tobytes()
        for word in new.difference(short):
            self.cache[word] = np.array(self._word(word), dtype=np.int32).tobytes()
        out = [np.frombuffer(b"".join(map(self.cache.__getitem__, words)), dtype=np.int32) for words in cut]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for word in new:
            if len(word) > CACHE_LENGTH:
                self.cache.pop(word, None)
        return out

    def decode(self, ids) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, several: list) -> list[str]:
        """Texts of many id sequences, by one look into the table of entries' bytes."""
        ends = np.concatenate([[0], np.cumsum([len(x) for x in several])]).astype(np.int64)
        ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in several]) if len(several) else np.zeros(0, dtype=np.int64)
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        at = np.concatenate([[0], np.cumsum(sizes)])
        data = self.buffer[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])].tobytes()
        cuts = at[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]

    def to_json(self) -> str:
        return json.dumps({"special": self.special, "merges": self.merges})

    @classmethod
    def from_json(cls, text: str) -> "Tokenizer":
        spec = json.loads(text)
        return cls(spec["merges"], spec["special"])

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> "Tokenizer":
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())


def train_merges(counts: dict[str, int], n_merges: int, base: int) -> list[tuple[int, int]]:
    """Most frequent pair first, ties to the smaller pair; counts are kept up to date for the words a merge touches."""
    words = [([base + b for b in w.encode("utf-8")], n) for w, n in sorted(counts.items())]
    pairs: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, (ids, n) in enumerate(words):
        for p in zip(ids, ids[1:], strict=False):
            pairs[p] += n
            where[p].add(i)
    merges: list[tuple[int, int]] = []
    # Counts change, so an entry may be out of date; it is then dropped, as the pair stands there with its new count too.
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    while len(merges) < n_merges and heap:
        count, best = heapq.heappop(heap)
        if pairs.get(best, 0) != -count:
            continue
        changed: set[tuple[int, int]] = set()
        new = base + 256 + len(merges)
        merges.append(best)
        for i in list(where.pop(best, ())):
            ids, n = words[i]
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] -= n
                changed.add(p)
                if pairs[p] <= 0:
                    del pairs[p]
                where[p].discard(i)
            out, j = [], 0
            while j < len(ids):
                hit = j + 1 < len(ids) and (ids[j], ids[j + 1]) == best
                out.append(new if hit else ids[j])
                j += 2 if hit else 1
            words[i] = (out, n)
            for p in zip(out, out[1:], strict=False):
                pairs[p] += n
                changed.add(p)
                where[p].add(i)
        for p in changed:
            if pairs.get(p, 0) > 0:
                heapq.heappush(heap, (-pairs[p], p))
    return merges


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of about SLICE characters or ids of a column, whatever the size of the batch."""
    rows = batch.column(column)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(rows) if pa.types.is_list(rows.type) else pc.utf8_length(rows), 0), dtype=np.int64))
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_column(docs: DataFrame, column: str, out_col: str, kind: DataType, change: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``docs`` with ``out_col``, which ``change`` makes of a slice of ``column``; a slice is handed on before the next is read."""
    docs = docs.drop(out_col) if out_col != column else docs
    kept = [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), change(part.column(column))], names=[*kept, out_col])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in kept), StructField(out_col, kind)]))


def first_documents(docs: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first ``n`` documents in order (with those of an equal last place): order numbers alone are sorted for it."""
    last = docs.select(order_col).where(F.col(order_col).isNotNull()).orderBy(order_col).limit(n).agg(F.max(order_col)).first()[0]
    return docs.where(F.col(order_col) <= last)


def train_tokenizer(docs: DataFrame, vocab_size: int = 32_000, special: tuple[str, ...] = ("<|endoftext|>",), sample_docs: int | None = None, order_col: str = "ord") -> Tokenizer:
    """From the first ``sample_docs`` documents in order (all if none is given); the driver gets merges alone."""
    counts = materialize(pretoken_counts(first_documents(docs, sample_docs, order_col) if sample_docs else docs))
    merges = bpe_training.train(counts, vocab_size - 256 - len(special), len(special))
    drop_table(counts)
    return Tokenizer([m[:2] for m in merges], list(special))


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Without a shuffle: each slice of a batch encodes the words it is first to see."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # the vocabulary

    def encode(texts: pa.Array) -> pa.Array:
        found = shared.value.encode_all([x or "" for x in texts.to_pylist()])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))

    return with_column(docs, text_col, out_col, ArrayType(IntegerType()), encode)


def word_dictionary(counts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``pretoken, n, ids`` of a table of pre-tokens: each one encoded once, wherever and however often it occurs."""
    return bpe_training.dictionary(counts, tokenizer.merges, tokenizer.base)


def encode_by_dictionary(docs: DataFrame, words: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids`` of every document, whose ids are unique, by joining its pre-tokens with the table ``words``.

    Null and empty texts have no ids. Neither side has a bound, so they are merge-joined; pre-tokens as frequent as " the"
    are spread over tasks by a hash of the document. The list of these has less than HOT_SHARE entries."""
    total = words.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(words.where(is_hot).select("pretoken", F.lit(True).alias("hot")))
    cut = docs.select(id_col, F.posexplode_outer(F.regexp_extract_all("text", F.lit(PRETOKEN), F.lit(0))).alias("pos", "pretoken"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    tokens = cut.join(hot, "pretoken", "left").withColumn("salt", salt).drop("hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = words.select("pretoken", "ids", F.explode(salts).alias("salt")).hint("merge")
    placed = tokens.join(dealt, ["pretoken", "salt"], "left").groupBy(id_col).agg(F.collect_list(F.struct("pos", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))).alias("parts"))
    return placed.select(id_col, F.flatten(F.transform(F.array_sort("parts"), lambda p: p["ids"])).alias("ids"))


def decode_documents(rows: DataFrame, tokenizer: Tokenizer, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def decode(ids: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), dtype=np.int64)
        return pa.array(shared.value.decode_all(np.split(ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])), pa.string())

    return with_column(rows, ids_col, out_col, StringType(), decode)

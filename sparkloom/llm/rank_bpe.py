"""Byte-level BPE by ranks, with a queue that finds the next merge in constant time however long a pre-token is.

The parts of a pre-token form a linked list of places. Every place whose part merges with the next one waits in the bucket
of that merge's rank. Over the buckets lie three levels of 64-bit words: a bit of the lowest level says that a bucket is
filled, a bit of a higher one that a word below it is not zero. Find-first-set, once a level, names the lowest rank; its
places are merged from left to right, and the two pairs that each merge makes are queued. Places whose parts have changed
since are not taken out of their buckets: they are skipped when they come up, as their pair no longer has that rank. So n
bytes cost n log n steps at most (the logarithm sorts a bucket), where looking for the lowest rank anew costs n squared.
Many pre-tokens are merged as one list of places with seams that no pair crosses.

Decoding: entries lie in one byte buffer with an offset table; the ids of many texts become bytes by array indexing."""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_LENGTH, CACHE_PIECES, tokenizer_path
from .common import spread, text_slices

#: White space as the library's patterns have it.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Up to here letters and numbers are the same in all versions of Unicode in use.
_LATIN = 0x24F
#: Characters of pre-tokens that are merged together.
BLOCK_LENGTH = 1 << 18


class RankQueue:
    """Places by rank; ``take`` hands out the lowest rank that has places."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = (ranks + 63) >> 6
            self.levels.append([0] * max(ranks, 1))

    def push(self, rank: int, places: list[int]) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            for level in self.levels:
                word = level[at := rank >> 6]
                level[at] = word | 1 << (rank & 63)
                if word:
                    break
                rank = at
        bucket += places

    def take(self) -> tuple[int, list[int]]:
        """The lowest filled rank and its places from left to right, which leave the queue; -1 if nothing waits."""
        if not self.levels[-1][0]:
            return -1, []
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | ((word & -word).bit_length() - 1)
        rank, places = at, self.buckets[at]
        self.buckets[rank] = []
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        places.sort()
        return rank, places


class RankEncoder:
    """Merges of pre-tokens, the lowest rank first and of equal ranks the leftmost."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        #: Rank of what two neighbouring entries make together, and the same for two bytes.
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.byte_pairs = np.array([self.pairs.get(int(a) << 32 | int(b), -1) for a in self.single for b in self.single])
        self.queue = RankQueue(max(ranks.values()) + 1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as unsigned 32-bit bytes. All words share one list of places, without a pair across a seam."""
        found = [self.ranks.get(w) for w in words]
        open_ = [w for w, r in zip(words, found, strict=True) if r is None and w]
        merged = iter(self._merge(open_) if open_ else ())
        return [(next(merged) if w else b"") if r is None else array("I", [r]).tobytes() for w, r in zip(words, found, strict=True)]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        n = len(data)
        first = np.append(self.byte_pairs[data[:-1] << 8 | data[1:]], -1)
        first[ends - 1] = -1
        queue, pairs, buckets = self.queue, self.pairs, self.queue.buckets
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        ranks, begins = np.unique(first[order], return_index=True)
        for rank, places in zip(ranks.tolist(), np.split(order, begins[1:]), strict=True) if len(ranks) else ():
            queue.push(rank, places.tolist())
        ids, waits = self.single[data].tolist(), first.tolist()  # under which rank a place waits: tells stale entries
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[np.append(0, ends[:-1])] = n, -1
        after, before = after.tolist(), before.tolist()
        while True:
            rank, places = queue.take()
            if rank < 0:
                break
            high = rank << 32
            for at, i in enumerate(places):
                if waits[i] != rank:
                    continue
                j = after[i]
                k = after[j]
                ids[i], ids[j], after[i], waits[i], waits[j] = rank, -1, k, -1, -1
                lowest = rank
                if k < n:
                    before[k] = i
                    new = pairs.get(high | ids[k])
                    if new is not None:
                        waits[i] = new
                        if bucket := buckets[new]:
                            bucket.append(i)
                        else:
                            queue.push(new, [i])
                        if new < lowest:
                            lowest = new
                h = before[i]
                if h >= 0:
                    new = pairs.get(ids[h] << 32 | rank)
                    if new is None:
                        waits[h] = -1
                    else:
                        waits[h] = new
                        if bucket := buckets[new]:
                            bucket.append(h)
                        else:
                            queue.push(new, [h])
                        if new < lowest:
                            lowest = new
                if lowest < rank:  # an entry made of later merges that ranks before them
                    if rest := places[at + 1 :]:
                        queue.push(rank, rest)
                    break
        out = np.array(ids)
        left = out >= 0
        stops = (4 * np.cumsum(left)[ends - 1]).tolist()
        flat = out[left].astype(np.uint32).tobytes()
        return [flat[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of an entry in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in f if line.strip())}


def _ranges(points: list[int]) -> str:
    """A character class of code points in ascending order."""
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _all_points() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def _too_new(pattern: str) -> set[str]:
    """Letters and numbers by the tables of ``regex`` that are neither by those of the library, which are older.

    The library is asked: a point is a letter to it if it doesn't part from an "a", a number if not from a "1"."""
    import tiktoken

    points = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", _all_points()[_LATIN + 1 :])]
    ranks = {bytes([b]): b for b in range(256)}
    for c in points:
        for lead in "a1":
            ranks[(lead + chr(c)).encode()] = len(ranks)
    library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return {chr(c) for c in points if all(len(library.encode_ordinary(lead + chr(c))) > 1 for lead in "a1")}


class RankCodec:
    """Pre-tokeniser, encoder and offset table of one file of ranks."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.encoder = RankEncoder(ranks)
        self.pattern = pattern
        latin = {k: _ranges([c for c in range(_LATIN + 1) if unicodedata.category(chr(c))[0] == k]) for k in "LN"}
        self.latin = re.compile(self._classes(latin["L"], latin["N"]))
        self.wide = None
        pieces = [b""] * (max(ranks.values()) + 1)
        for entry, rank in ranks.items():
            pieces[rank] = entry
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _classes(self, letters: str, numbers: str) -> str:
        """The pattern with classes written out: white space, letters and numbers as the library has them."""
        known = {"s": _SPACES, "p{L}": letters, "p{N}": numbers}
        inside = re.sub(r"\\(s|p\{L\}|p\{N\})(?=[^\[\]]*\])", lambda m: known[m[1]], self.pattern)
        return re.sub(r"\\(S|s|p\{L\}|p\{N\})", lambda m: f"[^{_SPACES}]" if m[1] == "S" else f"[{known[m[1]]}]", inside)

    def words(self, text: str) -> list[str]:
        if text.isascii() or ord(max(text)) <= _LATIN:
            return self.latin.findall(text)
        if self.wide is None:
            new, points = _too_new(self.pattern), _all_points()
            classes = [_ranges([ord(c) for c in regex.findall(kind, points) if c not in new]) for kind in (r"\p{L}", r"\p{N}")]
            self.wide = regex.compile(self._classes(*classes))
        return self.wide.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and where each text's begin (and the end).

        Pre-tokens not seen lately are encoded together, some 256 KB at a time; long ones are forgotten again."""
        cut = [self.words(t) for t in texts]
        known = self.young
        new: set[str] = set()
        for words in cut:
            new.update(filterfalse(known.__contains__, words))
        for word in [w for w in new if w in self.old]:
            known[word] = self.old[word]
            new.remove(word)
        block: list[str] = []
        size = 0
        for word in chain(new, (None,)):
            if word is not None:
                block.append(word)
                size += len(word)
            if word is None or size >= BLOCK_LENGTH:
                known.update(zip(block, self.encoder.encode([w.encode("utf-8") for w in block]), strict=True))
                block, size = [], 0
        flat = [b"".join(map(known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > CACHE_LENGTH:
                del known[word]
        if len(known) >= CACHE_PIECES:
            self.old, self.young = known, {}
        return np.frombuffer(b"".join(flat), dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) >> 2 for x in flat])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a sequence of ids, and where those of each id begin (and the end)."""
        ids = ids.astype(np.int64)
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        at = np.concatenate([[0], np.cumsum(lengths)])
        return self.buffer[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])], at


@lru_cache(maxsize=2)
def codec(name_or_path: str, pattern: str | None = None) -> RankCodec:
    """The codec of a file, made once in each Python process."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return RankCodec(tokenizer_path(name_or_path), pattern)


def _decoded(coder: RankCodec, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of many id sequences that lie one behind the other."""
    data, at = coder.decode(ids)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _round_trip(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    coder = codec(ranks, pattern)
    for batch in batches:
        for a, b in text_slices(batch.column(1), 1 << 22):
            ids, ends = coder.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.view(np.int32))), _decoded(coder, ids, ends)], names=["id", "ids", "decoded"])


def rank_round_trip(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded binary`` for every row, in no shuffle.

    ``ranks`` is a path every executor can open or the name of an installed public file; ``pattern`` cuts texts into
    pre-tokens (the public one if none is given) and must know no other classes than white space, letters and numbers.
    No string of a special token is special. Null and empty texts have no ids and decode to no bytes; repeated rows give
    repeated results; other columns are not read. A text without a break is one pre-token and takes memory in
    proportion to its length; it is not remembered.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spread(wanted).mapInArrow(partial(_round_trip, ranks=ranks, pattern=pattern), "id long, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    coder = codec(ranks, pattern)
    for batch in batches:
        lists = batch.column(1).to_pylist()
        ends = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
        ids = np.fromiter((i for x in lists for i in x or ()), dtype=np.int64, count=int(ends[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), _decoded(coder, ids, ends)], names=["id", "decoded"])


def rank_decode(rows: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded binary`` of stored id arrays; a null array decodes to no bytes."""
    wanted = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return wanted.mapInArrow(partial(_decode, ranks=ranks, pattern=pattern), "id long, decoded binary").withColumnRenamed("id", id_col)

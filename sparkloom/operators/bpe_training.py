"""Training of byte-level BPE in Spark: words and pair counts stay distributed, the driver sees candidate pairs and merges.

The distinct pre-tokens lie in blocks of arrays, and the counts of all neighbouring pairs in a table that is parted by pair.
A round asks the table for its most frequent pairs, and the blocks for the most frequent triple in which each of those
occurs that are likely to be among them. A merge makes no pair more frequent than its triples, so the pairs from the front of the list may be merged in one
round, as long as each is more frequent than every triple of the merges before it and shares no place with one of them: no
pair that these merges make could come before it, and its own count stands. That gives the merges of the one-by-one
algorithm, in its order. Then each block applies them and sends the change of counts in words they touch to the table.

Every ``CUT_ROUNDS`` rounds blocks and table are checkpointed in the shared folder, so their lineage stays short."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import delete_path, drop_table, materialize, shared_folder

#: Bytes of pre-tokens of a block, rounds between checkpoints, and bounds of the candidates of a round.
BLOCK_BYTES, CUT_ROUNDS, FEWEST, MOST = 1 << 19, 24, 64, 4096
#: Entries of counts that are held before they are summed (16 bytes each).
FOLD = 1 << 19
_LOW = (1 << 32) - 1


class Words(NamedTuple):
    """A block: tokens of its words one behind the other (32 bits), the word of each (32 bits), how often each word occurs."""

    ids: np.ndarray
    word: np.ndarray
    n: np.ndarray


class Counts(NamedTuple):
    """Pairs (left in the upper, right in the lower 32 bits) in ascending order and their counts."""

    pairs: np.ndarray
    n: np.ndarray


def summed(pairs: np.ndarray, n: np.ndarray) -> Counts:
    if not len(pairs):
        return Counts(pairs.astype(np.int64), n.astype(np.int64))
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return Counts(pairs[first], np.add.reduceat(n, first))


def neighbours(ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair at each place but the last, and whether both of its tokens are of one word."""
    return ids[:-1].astype(np.int64) << 32 | ids[1:], word[:-1] == word[1:]


def pair_counts(words: Words) -> Counts:
    pairs, inside = neighbours(words.ids, words.word)
    return summed(pairs[inside], words.n[words.word[:-1][inside]])


def places_of(pairs: np.ndarray, inside: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where one of the ``wanted`` pairs (ascending) stands, and which; of places that overlap, every other one."""
    if not len(wanted) or not len(pairs):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    which = np.minimum(np.searchsorted(wanted, pairs), len(wanted) - 1)
    places = np.flatnonzero(inside & (wanted[which] == pairs))
    # Only a pair of equal tokens overlaps itself; in a run of such places the first, the third and so on count.
    apart = np.append(True, np.diff(places) > 1) if len(places) else np.zeros(0, dtype=bool)
    begin = np.flatnonzero(apart)
    nth = np.arange(len(places)) - np.repeat(begin, np.diff(np.append(begin, len(places))))
    places = places[nth % 2 == 0]
    return places, which[places]


def apply_merges(words: Words, merges: list[tuple[int, int]], first_id: int) -> tuple[Words, Counts]:
    """A block after merges that share no place, and what that changes in its pair counts."""
    wanted = np.array([a << 32 | b for a, b in merges], dtype=np.int64)
    order = np.argsort(wanted)
    pairs, inside = neighbours(words.ids, words.word)
    places, which = places_of(pairs, inside, wanted[order])
    if not len(places):
        return words, Counts(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    touched = np.zeros(len(words.n), dtype=bool)
    touched[words.word[places]] = True
    ids, stays = words.ids.copy(), np.ones(len(words.ids), dtype=bool)
    ids[places] = first_id + order[which]
    stays[places + 1] = False
    after = Words(ids[stays], words.word[stays], words.n)
    part = lambda w: Words(w.ids[touched[w.word]], w.word[touched[w.word]], w.n)
    gone, come = pair_counts(part(words)), pair_counts(part(after))
    change = summed(np.concatenate([gone.pairs, come.pairs]), np.concatenate([-gone.n, come.n]))
    return after, Counts(change.pairs[change.n != 0], change.n[change.n != 0])


def triple_counts(words: Words, wanted: np.ndarray) -> Counts:
    """Counts of the triples in which ``wanted`` pairs occur: the pair's index in the upper half, then the side, then
    the third token."""
    if not len(wanted):
        return Counts(wanted, wanted)
    order = np.argsort(wanted)
    pairs, inside = neighbours(words.ids, words.word)
    which = np.minimum(np.searchsorted(wanted[order], pairs), len(wanted) - 1)
    places = np.flatnonzero(inside & (wanted[order][which] == pairs))
    keys, n = [], []
    for side, step in ((0, -1), (1, 2)):
        at = places[(places + step >= 0) & (places + step < len(words.ids))]
        at = at[words.word[at + step] == words.word[at]]
        keys.append(order[which[at]] << 32 | side << 31 | words.ids[at + step])
        n.append(words.n[words.word[at]])
    return summed(np.concatenate(keys), np.concatenate(n))


def dealt(counts: Counts, parts: int) -> Iterator[tuple[int, Counts]]:
    """Counts by the part of the table to which each pair belongs."""
    part = (counts.pairs * np.int64(0x9E3779B97F4A7C1 | 1) >> 20) % parts
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)).tolist():
        some = order[ends[p] : ends[p + 1]]
        yield p, Counts(counts.pairs[some], counts.n[some])


class Sum:
    """The sum of many counts, in any order; no more than ``FOLD`` entries, or thrice as many as there are pairs, are held."""

    def __init__(self):
        self.total, self.held, self.size = Counts(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), [], 0

    def add(self, counts: Counts) -> None:
        self.held.append(counts)
        self.size += len(counts.pairs)
        if self.size > max(FOLD, len(self.total.pairs)):
            self.fold()

    def fold(self) -> Counts:
        several = [self.total, *self.held]
        self.total = summed(np.concatenate([c.pairs for c in several]), np.concatenate([c.n for c in several]))
        self.held, self.size = [], 0
        return self.total


def together(several: Iterable[Counts]) -> Counts:
    total = Sum()
    for counts in several:
        total.add(counts)
    out = total.fold()
    return Counts(out.pairs[out.n > 0], out.n[out.n > 0])


def most_frequent(counts: Counts, k: int) -> list[tuple[int, int]]:
    """(-count, pair) of the first ``k`` pairs; equal counts in the order of the pairs."""
    order = np.lexsort((counts.pairs, -counts.n))[:k]
    return list(zip((-counts.n[order]).tolist(), counts.pairs[order].tolist(), strict=True))


def choose(candidates: list[tuple[int, int]], bounds: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The merges of a round: from the front of (-count, pair) while no pair that they make could come in between.

    ``bounds`` are the most frequent triples of some pairs; of others it is the pair's own count. A new pair of the same
    count would be behind an old one only if its left token is, so equality stops too."""
    out: list[tuple[int, int]] = []
    limit = 0
    lefts: set[int] = set()
    rights: set[int] = set()
    for count, pair in candidates:
        a, b = pair >> 32, pair & _LOW
        if -count <= limit or b in lefts or a in rights or len(out) >= room:
            break
        out.append((a, b))
        lefts.add(a)
        rights.add(b)
        limit = max(limit, bounds.get(pair, -count))
    return out


def likely(found: list[tuple[int, int]], triples: list[tuple[int, int, int]], guess: np.ndarray, chosen: list[tuple[int, int]], first_id: int, k: int) -> np.ndarray:
    """Pairs that may lead the next round: those that lead now, and the ones that the chosen merges make of their triples.

    Only for these does the next round know triples; a wrong guess costs merges of that round, never a wrong one."""
    new = {a << 32 | b: first_id + i for i, (a, b) in enumerate(chosen)}
    ranked = [(count, pair) for count, pair in found if pair not in new]
    for count, which, third in triples:
        made = new.get(int(guess[which]))
        if made is not None:
            other = third & (1 << 31) - 1
            ranked.append((count, made << 32 | other if third >> 31 else other << 32 | made))
    return np.array(sorted({pair for _, pair in sorted(ranked)[:k]}), dtype=np.int64)


def word_blocks(counts: DataFrame) -> DataFrame:
    """A table of blocks of ``pretoken, n`` rows: the pre-tokens' UTF-8 bytes, their lengths and counts, as binaries."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int]] = []
        size = 0

        def block():
            data = pa.array([b"".join(w for w, _ in held)], pa.binary())
            numbers = [pa.array([np.array(x, dtype=np.int64).tobytes()], pa.binary()) for x in ([len(w) for w, _ in held], [n for _, n in held])]
            return pa.RecordBatch.from_arrays([data, *numbers], names=["data", "lengths", "n"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((word.encode("utf-8"), n))
                size += len(held[-1][0])
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return counts.select("pretoken", "n").mapInArrow(pack, "data binary, lengths binary, n binary")


def _opened(row, base: int) -> Words:
    lengths, n = (np.frombuffer(bytes(x), dtype=np.int64) for x in (row.lengths, row.n))
    return Words(np.frombuffer(bytes(row.data), dtype=np.uint8).astype(np.int32) + np.int32(base), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), n)


def train(counts: DataFrame, n_merges: int, base: int) -> list[tuple[int, int, int]]:
    """(left, right, count) of each merge over a table ``pretoken, n`` of distinct pre-tokens with positive counts.

    The most frequent pair first, ties to the smaller pair; bytes have the ids from ``base`` on. Ends early if no pair is
    left. The driver gets at most ``MOST`` candidates from each part of the table a round."""
    if n_merges <= 0:
        return []
    spark = counts.sparkSession
    context, level = spark.sparkContext, StorageLevel.DISK_ONLY  # blocks are read once a round, in order
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    counts = counts.where("n > 0 and pretoken <> ''")
    size = counts.agg(F.sum(F.octet_length("pretoken"))).first()[0] or 0
    table = materialize(word_blocks(counts.coalesce(-(-size // BLOCK_BYTES) or 1)))
    blocks = table.rdd.map(lambda row: _opened(row, base))
    parts = max(1, min(blocks.getNumPartitions(), context.defaultParallelism))
    state = blocks.map(lambda words: (words, pair_counts(words))).persist(level)
    pairs, spent = None, []
    merges: list[tuple[int, int, int]] = []
    k, rounds, files, guess = FEWEST, 0, [], np.zeros(0, dtype=np.int64)
    while True:
        # Changes of counts and triples go to the parts in one shuffle; the parts of the table are zipped with them.
        sent = state.flatMap(lambda s: _tagged(s, guess, parts)).partitionBy(parts, int).mapPartitions(_gathered)
        before, pairs = pairs, (sent.map(lambda news: _updated(None, news, k)) if pairs is None else pairs.zip(sent).map(lambda p: _updated(p[0][0], p[1], k))).persist(level)
        cut = rounds % CUT_ROUNDS == CUT_ROUNDS - 1
        if cut:
            state.checkpoint()
            pairs.checkpoint()
        answers = pairs.map(lambda p: p[1:]).collect()
        for path in files if cut else ():
            delete_path(spark, path)
        files = [f for f in (state.getCheckpointFile(), pairs.getCheckpointFile()) if f] if cut else files
        for rdd in (*spent, *([before] if before is not None else [])):
            rdd.unpersist()
        found = sorted(c for top, _ in answers for c in top)[:k]
        if not found:
            break
        triples = sorted(t for _, some in answers for t in some)
        bounds: dict[int, int] = {int(pair): 0 for pair in guess}
        for count, which, _ in triples:
            bounds[int(guess[which])] = max(bounds[int(guess[which])], -count)
        chosen = choose(found, bounds, n_merges - len(merges))
        first_id = base + 256 + len(merges)
        merges += [(a, b, -count) for (a, b), (count, _) in zip(chosen, found, strict=False)]
        if len(merges) >= n_merges:
            break
        k = min(MOST, max(FEWEST, 4 * len(chosen)))
        guess = likely(found, triples, guess, chosen, first_id, k)
        spent, state = [state], state.map(lambda s, chosen=chosen, first_id=first_id: apply_merges(s[0], chosen, first_id)).persist(level)
        rounds += 1
    for rdd in (*spent, state, pairs):
        rdd.unpersist()
    for path in files:
        delete_path(spark, path)
    drop_table(table)
    return merges


def _tagged(state: tuple[Words, Counts], guess: np.ndarray, parts: int) -> Iterator[tuple[int, tuple[bool, Counts]]]:
    """A block's changes of counts, and its triples of the guessed pairs, by part."""
    for tag, counts in ((False, state[1]), (True, triple_counts(state[0], guess))):
        for p, some in dealt(counts, parts):
            yield p, (tag, some)


def _gathered(rows: Iterable[tuple[int, tuple[bool, Counts]]]) -> Iterator[list[tuple[bool, Counts]]]:
    """What all blocks send to a part of the table, summed as it comes, so it has as many entries as there are pairs and
    triples, not as many as there are blocks."""
    sums = {False: Sum(), True: Sum()}
    for _, (triple, counts) in rows:
        sums[triple].add(counts)
    yield [(triple, x.fold()) for triple, x in sums.items()]


def _updated(pairs: Counts | None, news: list[tuple[bool, Counts]], k: int) -> tuple[Counts, list, list]:
    """A part of the table after changes, its most frequent pairs, and the most frequent triples as (-count, index of the
    guess, side and third token): each pair's first one at least."""
    pairs = together([*([pairs] if pairs is not None else []), *[c for triple, c in news if not triple]])
    triples = together(c for triple, c in news if triple)
    which = triples.pairs >> 32
    order = np.lexsort((triples.pairs, -triples.n))
    _, first = np.unique(which[order], return_index=True)
    order = order[np.union1d(first, np.arange(min(2 * k, len(order))))]
    return pairs, most_frequent(pairs, k), list(zip((-triples.n[order]).tolist(), which[order].tolist(), (triples.pairs[order] & _LOW).tolist(), strict=True))


def encode_words(words: list[bytes], merges: list[tuple[int, int]], base: int) -> list[np.ndarray]:
    """Ids of each word, all words at once: in every round each word's merge of the lowest rank is made throughout it.

    Rounds are as many as the word with most different merges needs; words that are done take no further part."""
    keys = np.array([a << 32 | b for a, b in merges], dtype=np.int64)
    order = np.argsort(keys)
    keys, none = keys[order], len(merges)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ids = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64) + base
    word = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ids):
        pairs, inside = neighbours(ids, word)
        rank = np.full(len(ids), none)
        if none:
            at = np.minimum(np.searchsorted(keys, pairs), none - 1)
            rank[:-1] = np.where(inside & (keys[at] == pairs), order[at], none)
        begin = np.flatnonzero(np.append(True, ~inside))
        best = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(ids))))
        done.append((ids[best == none], word[best == none]))
        live = best < none
        ids, word, rank, best = ids[live], word[live], rank[live], best[live]
        pairs, inside = neighbours(ids, word)
        due = inside & (rank[:-1] == best[:-1]) if len(ids) else inside
        places, _ = places_of(pairs, due, np.unique(pairs[due]))
        stays = np.ones(len(ids), dtype=bool)
        stays[places + 1] = False
        ids[places] = base + 256 + rank[places]
        ids, word = ids[stays], word[stays]
    all_ids, all_words = (np.concatenate(x) if done else np.zeros(0, dtype=np.int64) for x in zip(*done, strict=True)) if done else (np.zeros(0, dtype=np.int64),) * 2
    sequence = np.argsort(all_words, kind="stable")
    ends = np.searchsorted(all_words[sequence], np.arange(len(words) + 1))
    return np.split(all_ids[sequence].astype(np.int32), ends[1:-1]) if len(words) else []


def dictionary(counts: DataFrame, merges: list[tuple[int, int]], base: int) -> DataFrame:
    """``pretoken, n, ids array<int>``: every distinct pre-token encoded once."""
    shared = counts.sparkSession.sparkContext.broadcast(list(merges))  # the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = encode_words([w.encode("utf-8") for w in batch.column(0).to_pylist()], shared.value, base)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["pretoken", "n", "ids"])

    return counts.select("pretoken", F.col("n").cast("long").alias("n")).mapInArrow(encode, "pretoken string, n long, ids array<int>")

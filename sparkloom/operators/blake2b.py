"""BLAKE2b with digests of four bytes over many messages at once, and MinHash signatures of whole batches of texts.

The compression function runs on arrays: a state is sixteen rows, each a word of 64 bits of every message, and a mixing works
on four rows in place. Messages with equal numbers of 128-byte blocks go together,
``STEP`` at a time, so that states stay in the processor's cache. A shingle is a slice of the normalised text, so the blocks
are gathered from one buffer of bytes and no Python object is made for a shingle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np

# Fixed values of the published algorithm: the initial state and the order of message words in each round.
IV = np.array(
    [0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179],
    dtype=np.uint64,
)
SIGMA = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15],
    [14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3],
    [11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4],
    [7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8],
    [9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13],
    [2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9],
    [12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11],
    [13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10],
    [6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5],
    [10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0],
]
ROUNDS, BLOCK = 12, 128
#: Messages of one step, messages below which a step is not worth its calls, bytes of text and permuted values of one step.
STEP, FEW, TEXT_BYTES, PERMUTED = 4096, 24, 1 << 20, 1 << 15
PRIME = np.uint64((1 << 61) - 1)


#: The rows of the state that are mixed together: columns, then diagonals.
MIXED = [(i, 4 + i, 8 + i, 12 + i) for i in range(4)] + [(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4)]
TURNS = {r: (np.uint64(r), np.uint64(64 - r)) for r in (32, 24, 16, 63)}


def _turn(x: np.ndarray, by: int, spare: np.ndarray) -> None:
    """Rotates words to the right in place."""
    right, left = TURNS[by]
    np.left_shift(x, left, out=spare)
    np.right_shift(x, right, out=x)
    np.bitwise_or(x, spare, out=x)


def _half_mix(a, b, c, d, word, first: int, second: int, spare) -> None:
    np.add(a, b, out=a)
    np.add(a, word, out=a)
    np.bitwise_xor(d, a, out=d)
    _turn(d, first, spare)
    np.add(c, d, out=c)
    np.bitwise_xor(b, c, out=b)
    _turn(b, second, spare)


def _compressed(h: np.ndarray, words: np.ndarray, taken: np.ndarray, last: bool) -> np.ndarray:
    """The next state, 8 x n, from message words, 16 x n, and the bytes taken in so far."""
    v = np.concatenate([h, np.repeat(IV[:, None], h.shape[1], axis=1)])
    v[12] ^= taken
    if last:
        np.invert(v[14], out=v[14])
    rows, word, spare = list(v), list(words), np.empty_like(v[0])
    for r in range(ROUNDS):
        order = SIGMA[r % len(SIGMA)]
        for at, (a, b, c, d) in enumerate(MIXED):
            _half_mix(rows[a], rows[b], rows[c], rows[d], word[order[2 * at]], 32, 24, spare)
            _half_mix(rows[a], rows[b], rows[c], rows[d], word[order[2 * at + 1]], 16, 63, spare)
    return h ^ v[:8] ^ v[8:]


def hashes32(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The four-byte digests, as big-endian numbers, of slices of a buffer of bytes.

    Slices of a number of blocks that few others share, such as those around one very long word, are hashed by hashlib."""
    out = np.zeros(len(starts), dtype=np.uint64)
    padded = np.concatenate([buffer, np.zeros(BLOCK, np.uint8)])
    blocks_at = np.lib.stride_tricks.sliding_window_view(padded, BLOCK)
    counts = np.maximum(-(-lengths // BLOCK), 1)
    order = np.argsort(counts, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(counts[order])) + 1):
        if len(group) < FEW:
            for i in group.tolist():
                out[i] = int.from_bytes(hashlib.blake2b(buffer[starts[i] : starts[i] + lengths[i]].data, digest_size=4).digest(), "big")
            continue
        for at in range(0, len(group), STEP):
            some = group[at : at + STEP]
            begin, size, blocks = starts[some], lengths[some], int(counts[some[0]])
            h = np.repeat(IV[:, None], len(some), axis=1)
            h[0] ^= np.uint64(0x01010000 | 4)
            for k in range(blocks):
                last = k == blocks - 1
                data = blocks_at[begin + k * BLOCK]
                if last:
                    data = np.where(np.arange(BLOCK)[None, :] < (size - k * BLOCK)[:, None], data, np.uint8(0))
                words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u8").T)
                h = _compressed(h, words, (size if last else np.full(len(some), (k + 1) * BLOCK)).astype(np.uint64), last)
            out[some] = (h[0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).byteswap()
    return out


def _shingles(normal: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts behind each other, and of every run of k words its text's number, start and length. A text of fewer words is
    one run, one without words has none. The words of a text are parted by single blanks."""
    buffer = np.frombuffer(b"".join([x + b" " for x in normal]), dtype=np.uint8)
    size = np.fromiter(map(len, normal), dtype=np.int64, count=len(normal))
    begins = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    stops = np.flatnonzero(buffer == 32)  # one behind each word, and one for each text without any
    text = np.searchsorted(begins, stops, side="right") - 1
    opening = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    words = np.bincount(text, minlength=len(normal))
    place = np.arange(len(stops)) - np.concatenate([[0], np.cumsum(words)])[text]
    run = (size[text] > 0) & ((place + k <= words[text]) | ((place == 0) & (words[text] < k)))
    first = np.flatnonzero(run)
    final = first + np.minimum(k, words[text[first]]) - 1
    return buffer, text[first], opening[first], stops[final] - opening[first]


def signatures_of(texts: Iterable[str | None], k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash signatures, texts by permutations: minima of (a x + b) mod 2^61 - 1 over the hashes x of the shingles.

    A text without words, or null, has the modulus throughout. Texts are worked on in groups of ``TEXT_BYTES``; a longer one
    is a group of its own. a, b and the hashes are below 2^32, so no product overflows, and the remainder takes one fold."""
    normal = [" ".join((x or "").split()).encode("utf-8", "surrogatepass") for x in texts]
    out = np.full((len(normal), len(a)), PRIME, dtype=np.uint64)
    rows, at = max(1, PERMUTED // max(len(a), 1)), 0
    while at < len(normal):
        end, held = at, 0
        while end < len(normal) and (end == at or held + len(normal[end]) <= TEXT_BYTES):
            held += len(normal[end])
            end += 1
        buffer, text, starts, lengths = _shingles(normal[at:end], k)
        hashes = hashes32(buffer, starts, lengths)
        for i in range(0, len(hashes), rows):
            x = hashes[i : i + rows, None] * a + b
            x = (x & PRIME) + (x >> np.uint64(61))
            x = np.minimum(x, x - PRIME)
            of = text[i : i + rows]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            to = at + of[edges]
            out[to] = np.minimum(out[to], np.minimum.reduceat(x, edges, axis=0))
        at = end
    return out

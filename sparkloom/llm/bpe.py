"""Byte-pair encoding and decoding of whole texts.

Encoding: one Aho-Corasick pass over a word gives every vocabulary entry that occurs in it. A backtracking search takes
the longest entry at the current place whose pair with the previous one is compatible, and marks places it had to leave,
so each place is left at most once and the work is linear. Two entries are compatible if merging their concatenation
from single bytes ends in just these two; the table is filled on demand from the merge list. The result is the exact
merge result, without running merges.

Decoding: entries lie in one byte buffer with an offset table; a whole id sequence becomes bytes by array indexing.

Texts are cut at white space first; pieces seen before come from a per-process cache of
short ones, bounded in number and length, which only saves time."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_slices

#: Stands for the end-of-word suffix inside words; a private-use code point that byte-level words never hold.
END = "\ue000"
#: Bounds of the cache: pieces of each of its two generations, and characters of a piece.
CACHE_PIECES, CACHE_LENGTH = 400_000, 64
#: Last code point whose class is the same in every version of Unicode that libraries use.
_LATIN = "\u024f"
_BEYOND = re.compile("[^\x00-\u024f]")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: White space as tokenizers' own patterns have it.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def tokenizer_path(name_or_path: str) -> str:
    """A path, or the name of a file of the installed public tokenizers."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


ALPHABET = byte_alphabet()


class BacktrackingEncoder:
    """Exact BPE of one word by longest matches and pair compatibility."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.suffix = suffix
        inner = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) else t
        merges = [(inner(a), inner(b)) for a, b in merges]
        made: dict[str, tuple[str, str]] = {}
        for a, b in merges:
            made.setdefault(a + b, (a, b))
        ids = {inner(t): i for t, i in vocab.items()}
        base = [t for t in ids if t not in made and len(t.removesuffix(END)) == 1]
        names = base + [t for t in made if t in ids]
        number = {t: i for i, t in enumerate(names)}
        self.ids = [ids[t] for t in names]
        self.lengths = [len(t) for t in names]
        self.left, self.right = list(range(len(names))), list(range(len(names)))
        self.pairs: dict[int, int] = {}
        for t, (a, b) in made.items():
            if t in number:
                self.left[number[t]], self.right[number[t]] = number[a], number[b]
                self.pairs[number[a] << 32 | number[b]] = number[t]
        #: The entry each byte starts with, and for every entry the next shorter one that is its prefix (or -1).
        self.single = {t: i for t, i in number.items() if len(t.removesuffix(END)) == 1}
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in names]
        self.automaton = ahocorasick.Automaton()
        for t, i in number.items():
            if t not in self.single:
                self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        self.table: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two entries' concatenation leaves exactly these two.

        Undo merges on the two sides of the seam from the latest to the earliest; at each step no merge across the seam
        may come before the one that is undone."""
        key = a << 32 | b
        known = self.table.get(key)
        if known is not None:
            return known
        limit, x, y = len(self.ids), a, b
        while True:
            across = self.pairs.get(x << 32 | y)
            if across is not None and across < limit:
                good = False
                break
            shrink_left = x > y
            if not shrink_left and self.left[y] == y:
                shrink_left = True
                if self.right[x] == x:
                    good = True
                    break
            elif shrink_left and self.right[x] == x:
                shrink_left = False
                if self.left[y] == y:
                    good = True
                    break
            if shrink_left:
                limit, x = x, self.right[x]
            else:
                limit, y = y + 1, self.left[y]
        if len(self.table) > 2_000_000:
            self.table.clear()
        self.table[key] = good
        return good

    def encode(self, word: str) -> list[int]:
        """Ids of one word in the byte alphabet."""
        if not word:
            return []
        single = self.single
        longest = [single[c] for c in word]
        n = len(word)
        if self.suffix:
            longest[-1] = single[word[-1] + END]
            longest.append(-1)
            word, n = word + END, n + 1
        for end, (before, token) in self.automaton.iter(word):
            longest[end - before] = token  # ends come in order, so the longest one stays
        lengths, shorter, table = self.lengths, self.shorter, self.table
        left = bytearray(n + 1)
        if self.suffix:
            left[n - 1] = 1
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                after = at + lengths[token]
                if not left[after]:
                    if last < 0:
                        break
                    good = table.get(last << 32 | token)
                    if good is None:
                        good = self.compatible(last, token)
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if after == n:
                    ids = self.ids
                    return [ids[t] for t in out]
                at, last, token = after, token, longest[after]
            else:
                left[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
                last = out[-1] if out else -1


class Codec:
    """Normaliser, pre-tokeniser, encoder and offset table of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.encoder = BacktrackingEncoder(vocab, merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        steps = spec.get("normalizer") or {}
        steps = steps.get("normalizers", [steps] if steps else [])
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        pre = spec["pre_tokenizer"]
        pattern = next(s["pattern"]["Regex"] for s in pre["pretokenizers"] if s["type"] == "Split")
        self.pattern = regex.compile(pattern.replace("\\s", _SPACES))
        self.bytes_decoded = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        back = {c: b for b, c in enumerate(ALPHABET)}
        for t, i in [*vocab.items(), *self.special.items()]:
            pieces[i] = bytes(back[c] for c in t) if self.bytes_decoded and t not in self.special else t.encode("utf-8")
            if not self.bytes_decoded:
                pieces[i] += b" "
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.library = None
        self.path = path

    def _words(self, piece: str) -> list[str]:
        """Words of a piece in the byte alphabet."""
        if max(piece) <= _LATIN:  # unchanged by NFC
            piece = piece.lower() if self.lower else piece
            words = [piece] if piece.isalpha() else self.pattern.findall(piece)
        else:  # letters, case and normal forms depend on the version of Unicode here: as the library itself cuts it
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            text = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return ["".join([ALPHABET[b] for b in w.encode("utf-8")]) for w in words]

    def _piece(self, piece: str) -> bytes:
        """Ids, as unsigned 32-bit bytes, of a text without special tokens."""
        known = self.old.get(piece)
        if known is None:
            if piece[:-1].isalpha() and piece[-1] in ",.!?;:" and max(piece) <= _LATIN:
                known = self._known(piece[:-1]) + self._known(piece[-1])
            else:
                ids: list[int] = []
                for word in self._words(piece):
                    ids += self.encoder.encode(word)
                known = array("I", ids).tobytes()
        if len(piece) > CACHE_LENGTH:  # unspaced scripts make a piece of a whole text
            return known
        if len(self.young) >= CACHE_PIECES:
            self.old, self.young = self.young, {}
        self.young[piece] = known
        return known

    def _known(self, piece: str) -> bytes:
        return self.young.get(piece) or self._piece(piece)

    def _plain(self, text: str) -> list[bytes]:
        if self.lower and not _BEYOND.search(text):
            text = text.lower()
        if _ODD_SPACE.search(text):  # white space to Python, but not to the pattern
            return [self._piece(text)]
        known = self.young.get
        return [known(piece) or self._piece(piece) for piece in text.split()]

    def encode(self, text: str) -> np.ndarray:
        if self.special_pattern is None or "<" not in text:
            return np.frombuffer(b"".join(self._plain(text)), dtype=np.uint32)
        parts, at = [], 0
        for m in self.special_pattern.finditer(text):
            parts += self._plain(text[at : m.start()])
            parts.append(np.array([self.special[m[0]]], dtype=np.uint32).tobytes())
            at = m.end()
        return np.frombuffer(b"".join(parts + self._plain(text[at:])), dtype=np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of an id sequence and where each id's bytes begin (and the end)."""
        ids = ids.astype(np.int64)
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        at = np.concatenate([[0], np.cumsum(lengths)])
        return self.buffer[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])], at

    def decode(self, ids: np.ndarray) -> bytes:
        out, _ = self.decode_bytes(ids)
        if self.bytes_decoded:
            return out.tobytes().decode("utf-8", "replace").encode("utf-8")
        return out[:-1].tobytes()  # one space between entries


@lru_cache(maxsize=2)
def codec(name_or_path: str) -> Codec:
    """The codec of a file, made once in each Python process."""
    return Codec(tokenizer_path(name_or_path))


def _round_trip(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    coder = codec(tokenizer)
    for batch in batches:
        for a, b in text_slices(batch.column(1), 1 << 22):
            ids = [coder.encode(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32))
            decoded = pa.array([coder.decode(x) for x in ids], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.ListArray.from_arrays(ends, flat), decoded], names=["id", "ids", "decoded"])


def bpe_round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded string`` for every row, in no shuffle.

    ``tokenizer`` is a path every executor can open or the name of an installed public file. Null and empty texts have
    no ids and decode to the empty text; strings of special tokens in a text become their ids, as the library does.
    Repeated rows give repeated results; other columns are not read.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spread(wanted).mapInArrow(partial(_round_trip, tokenizer=tokenizer), "id long, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def _decode(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    coder = codec(tokenizer)
    for batch in batches:
        decoded = [coder.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary()).cast(pa.string())], names=["id", "decoded"])


def bpe_decode(rows: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` of stored id arrays; a null array decodes to the empty text."""
    wanted = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return wanted.mapInArrow(partial(_decode, tokenizer=tokenizer), "id long, decoded string").withColumnRenamed("id", id_col)

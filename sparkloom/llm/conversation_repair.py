"""Repair of conversation structure at least cost, by a lazily determinised weighted automaton.

A repaired conversation's role initials read ``(s?(ua)+)?``. Each row is kept, given the role that is due, or deleted, and
rows without text may be inserted anywhere; every edit has a cost. As an automaton this is nondeterministic: four states
(nothing yet, behind s, behind u, behind a), and several edits lead from one to another. It is determinised as rows come:
the costs to go from each of the four states, less the smallest of them, are one state of a deterministic automaton, and
the smallest one is the weight of the arc that leads there. Such vectors are few, as costs differ by a few edits at most;
what a state does on one of nine kinds of row is computed once in a process and kept in a transition table.

A scan of the table from the last row to the first gives the cost. The trace goes back the other way, from the first row to
the last, along tight arcs, those whose cost is the difference of the costs to go; of several it takes the least letter, so
of all cheapest lists of edits it finds the first one in ASCII order. (Costs to go, not costs so far, are what a least list
read from its front asks for; that is why the scan starts at the end.)

Rows are sorted by ranges of (conversation, turn, role, text), after equal rows were counted into one, so a conversation
of any size is dealt out over tasks. One that a task sees whole is repaired there. Of others, tasks write pieces of a
bounded number of rows: a piece's 4 x 4 matrix of costs takes the place of its rows, matrices are multiplied from the last
one to the first, and each piece is traced by itself from all four states. Only SHA-256 of a conversation's text, which has
no parts, is one stream through one task, a piece at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Costs of edits and of a truncated row that stays; letters of edits, in ASCII order; white space.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACES = " \t\n\x0b\x0c\r"
#: Role initials by number, 3 is any other; the state behind each initial, and the role due in each state.
INITIALS = "sua"
BEHIND = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
DUE, DUE_NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Kinds of rows: twice the initial's number, one more if truncated; the last must be deleted.
MUST_GO, KINDS = 8, 9
FAR = 1 << 60
#: Bounds of a piece of a conversation: rows, and bytes of text beyond which no further row is added.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 22


class Automaton:
    """States are tuples of costs to go from the four structural states, the smallest 0; ``moves`` are tight arcs."""

    def __init__(self):
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.next = np.zeros((0, KINDS), dtype=np.int64)
        self.weight = np.zeros((0, KINDS), dtype=np.int64)
        self.move = np.zeros((0, KINDS, 4), dtype=np.int64)
        #: Letters up to the row's own edit and the state behind it; every move of the table is one of these few.
        self.moves: list[tuple[str, int]] = []
        self.move_number: dict[tuple[str, int], int] = {}

    def state(self, costs: list[int]) -> tuple[int, int]:
        """Number and weight of a vector of costs to go."""
        least = min(costs)
        vector = tuple(c - least if c < FAR else FAR for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.next = np.vstack([self.next, np.full((1, KINDS), -1)])
            self.weight = np.vstack([self.weight, np.zeros((1, KINDS), dtype=np.int64)])
            self.move = np.concatenate([self.move, np.full((1, KINDS, 4), -1)])
        return self.number[vector], least

    @staticmethod
    def inserted(costs: list[int]) -> list[int]:
        """Costs to go if rows may be inserted first; two are enough to pass from any state to any other."""
        for _ in range(2):
            costs = [min(c, INSERT + costs[DUE_NEXT[q]]) for q, c in enumerate(costs)]
        return [min(c, FAR) for c in costs]

    def end(self) -> int:
        """The state behind the last row: nothing, or an assistant's row, may end a conversation."""
        return self.state(self.inserted([0, FAR, FAR, 0]))[0]

    def edits(self, q: int, kind: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
        """Letter, cost to go and next state of what may be done with a row of this kind, in order of letters."""
        out = [("D", DELETE + after[q], q)]
        if kind != MUST_GO:
            extra = TRUNCATED * (kind & 1)
            kept = BEHIND[q].get(kind >> 1)
            if kept is not None:
                out.append(("K", extra + after[kept], kept))
            out.append(("R", REROLE + extra + after[DUE_NEXT[q]], DUE_NEXT[q]))
        return out

    def read(self, state: int, kind: int) -> None:
        """Fills the table's entry for a row of this kind in front of ``state``."""
        after = self.vectors[state]
        here = self.inserted([min(cost for _, cost, _ in self.edits(q, kind, after)) for q in range(4)])
        for start in range(4):
            letters, q = "", start
            while True:
                tight = [(letter, to) for letter, cost, to in self.edits(q, kind, after) if cost == here[q]]
                if INSERT + here[DUE_NEXT[q]] == here[q] and not (tight and tight[0][0] == "D") and here[q] < FAR:
                    letters, q = letters + "I", DUE_NEXT[q]
                    continue
                letter, q = tight[0] if tight else ("D", q)
                break
            move = (letters + letter, q)
            if move not in self.move_number:
                self.move_number[move] = len(self.moves)
                self.moves.append(move)
            self.move[state, kind, start] = self.move_number[move]
        to, weight = self.state(here)
        self.next[state, kind], self.weight[state, kind] = to, weight

    def fill(self, states: np.ndarray, kinds: np.ndarray) -> None:
        missing = self.next[states, kinds] < 0
        if missing.any():
            for state, kind in set(zip(states[missing].tolist(), kinds[missing].tolist(), strict=True)):
                self.read(state, kind)

    def scan(self, kinds: np.ndarray, runs: np.ndarray, begins: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many sequences that lie one behind the other: the state behind each row, and each sequence's state and cost.

        ``runs`` are rows behind a row that must go as well: their arcs lead from each state to itself. All sequences
        step together, from their ends, the long ones first, so those still running stay in front."""
        stops = np.append(begins[1:], len(kinds))
        order = np.argsort(begins - stops, kind="stable")
        sizes, last = (stops - begins)[order], stops[order] - 1
        behind = np.zeros(len(kinds), dtype=np.int64)
        state, cost = np.full(len(begins), start), np.zeros(len(begins), dtype=np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            rows = last[:live] - step
            now, seen = state[:live], kinds[rows]
            self.fill(now, seen)
            behind[rows] = now
            cost[:live] += self.weight[now, seen] + DELETE * runs[rows]
            state[:live] = self.next[now, seen]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return behind, state[back], cost[back]

    def trace(self, kinds: np.ndarray, behind: np.ndarray, begins: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the same sequences from the structural state ``start``: each row's move and each sequence's last state."""
        stops = np.append(begins[1:], len(kinds))
        order = np.argsort(begins - stops, kind="stable")
        sizes, first = (stops - begins)[order], begins[order]
        to = np.array([q for _, q in self.moves], dtype=np.int64)
        moves, q = np.zeros(len(kinds), dtype=np.int64), np.full(len(begins), start)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            rows = first[:live] + step
            moves[rows] = self.move[behind[rows], kinds[rows], q[:live]]
            q[:live] = to[moves[rows]]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return moves, q[back]


#: The transition table of this process.
TABLE = Automaton()
#: Inserted rows behind the last one, by structural state, and the letters for them.
TAILS = ("", "II", "I", "")


def edited(letters: str, q: int, role: str, text: str) -> Iterator[str]:
    """``role:text`` of the rows that the edits up to and with a row's own make, from structural state ``q``."""
    for letter in letters:
        if letter == "I":
            yield f"{DUE[q]}:"
            q = DUE_NEXT[q]
        elif letter == "K":
            yield f"{role}:{text}"
        elif letter == "R":
            yield f"{DUE[q]}:{text}"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies`` after planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row,
    1 empties its text, 2 takes its ``[.!?]``, 3 repeats it, 4 makes it a user's. Nulls are one space in the number and
    in role and text; conv_id and turn stay null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.encode(F.concat(space(conv_col), F.lit(":"), space(turn_col)), "UTF-8")) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    role = F.when(hit == 4, F.lit("user")).otherwise(space(role_col))
    copies = F.when(hit == 3, F.lit(2)).otherwise(F.lit(1)).cast("long")
    return rows.where(hit != 0).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows with copies counted into one and their ``look`` (initial + 4 x fault, 1 blank, 2 truncated), in ranges.

    Range bounds are learned from the head of the text, which orders texts as far as it goes."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    fault = F.when(end == "", 1).when(end.isin(".", "!", "?"), 0).otherwise(2)
    initial = F.substring("role", 1, 1)
    look = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 4 * fault
    ranged = counted.withColumn("look", look.cast("int")).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ROWS = {"turns": "array<long>", "roles": "array<string>", "texts": "array<string>", "looks": "array<int>", "copies": "array<long>"}
_SCANNED = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string, piece long, " + ", ".join(f"{k} {t}" for k, t in _ROWS.items())


def _begins(ids: pa.Array) -> np.ndarray:
    """Where rows of a further conversation begin."""
    null, value = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
    new = np.append(True, (null[1:] != null[:-1]) | (value[1:] != value[:-1])) if len(ids) else np.zeros(0, dtype=bool)
    return np.flatnonzero(new)


def _per(begins: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else np.zeros(0, dtype=np.int64)


def kinds_of(looks: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    fault = looks >> 2
    return np.where((fault == 1) | repeated, MUST_GO, 2 * (looks & 3) + (fault == 2))


def structure(looks: np.ndarray, copies: np.ndarray, repeated: np.ndarray, begins: np.ndarray, turns: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each sequence's rows: faults, illegal neighbours, turns."""
    blank, initial = (looks >> 2) == 1, looks & 3
    first = np.zeros(len(looks), dtype=bool)
    first[begins] = True
    before = np.append(-1, initial[:-1])
    legal = ((before == 0) & (initial == 1)) | ((before == 1) & (initial == 2)) | ((before == 2) & (initial == 1))
    known, turn = ~np.asarray(turns.is_null()), np.asarray(turns.fill_null(0))
    same = np.append(False, known[1:] & known[:-1] & (turn[1:] == turn[:-1])) & ~first if len(looks) else first
    return {
        "blank": _per(begins, np.where(blank, copies, 0)), "duplicate": _per(begins, np.where(blank, 0, copies - 1 + repeated)),
        "truncated": _per(begins, ((looks >> 2) == 2) & ~repeated), "illegal": _per(begins, (~legal & ~first) + copies - 1),
        "low": np.minimum.reduceat(np.where(known, turn, FAR), begins), "high": np.maximum.reduceat(np.where(known, turn, -FAR), begins), "turns": _per(begins, known & ~same),
    }


def gaps(low: np.ndarray, high: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return np.where(turns > 0, high - low + 1 - turns, 0)


def _repair(rows: pa.Table) -> pa.RecordBatch:
    """Results of conversations that are whole here."""
    ids = rows.column("conv_id").combine_chunks()
    begins = _begins(ids)
    looks, copies = rows.column("look").to_numpy().astype(np.int64), rows.column("copies").to_numpy()
    roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
    repeated, stops = np.zeros(len(looks), dtype=bool), np.append(begins[1:], len(looks)).tolist()
    for a, b in zip(begins.tolist(), stops, strict=True):
        seen: set[tuple[str, str]] = set()
        for i in range(a, b):
            repeated[i] = looks[i] >> 2 != 1 and (roles[i], texts[i]) in seen
            seen.add((roles[i], texts[i]))
    kinds, runs = kinds_of(looks, repeated), copies - 1
    behind, state, cost = TABLE.scan(kinds, runs, begins, TABLE.end())
    moves, last = TABLE.trace(kinds, behind, begins, 0)
    found = structure(looks, copies, repeated, begins, rows.column("turn").combine_chunks())
    found["gaps"] = gaps(found["low"], found["high"], found["turns"])
    found["cost"] = cost + np.array([TABLE.vectors[s][0] for s in state.tolist()], dtype=np.int64)
    audits, digests = [], []
    for a, b, end in zip(begins.tolist(), stops, last.tolist(), strict=True):
        audit, said, q = [], [], 0
        for i, move, run in zip(range(a, b), moves[a:b].tolist(), runs[a:b].tolist(), strict=True):
            letters, to = TABLE.moves[move]
            said += edited(letters, q, roles[i], texts[i])
            audit.append(letters + "D" * run)
            q = to
        said += edited(TAILS[end], end, "", "")
        audits.append("".join(audit) + TAILS[end])
        digests.append(hashlib.sha256("\n".join(said).encode("utf-8")).hexdigest())
    n = len(begins)
    results = [pa.array(found[c].astype(np.int64), pa.int64()) for c in _COUNTS]
    empty = [pa.nulls(n, pa.int64())] + [pa.nulls(n, t) for t in (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(begins)), *results, pa.array(audits, pa.string()), pa.array(digests, pa.string()), *empty], names=["conv_id", *_COUNTS, "audit", "repaired_sha256", "piece", *_ROWS])


def _piece(rows: pa.Table, number: int) -> pa.RecordBatch:
    """Rows of one conversation that may have more of them elsewhere, as one row."""
    whole = lambda c, t: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).combine_chunks().cast(t))
    results = [pa.nulls(1, pa.int64()) for _ in _COUNTS] + [pa.nulls(1, pa.string())] * 2
    lists = [whole("turn", pa.int64()), whole("role", pa.string()), whole("text", pa.string()), whole("look", pa.int32()), whole("copies", pa.int64())]
    return pa.RecordBatch.from_arrays([rows.column("conv_id").combine_chunks().slice(0, 1), *results, pa.array([number]), *lists], names=["conv_id", *_COUNTS, "audit", "repaired_sha256", "piece", *_ROWS])


def _pieces(rows: pa.Table) -> Iterator[pa.Table]:
    """Cuts rows of one conversation at the bounds of a piece."""
    sizes = np.cumsum(np.asarray(pc.binary_length(rows.column("text").combine_chunks())).astype(np.int64))
    at = 0
    while at < rows.num_rows:
        room = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE_BYTES, side="right"))
        stop = max(at + 1, min(room, at + PIECE_ROWS))
        yield rows.slice(at, stop - at)
        at = stop


def _scan_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations of a range are repaired; its first and its last one may go on in the next range and are
    written in pieces, as is one of more rows than a piece has as soon as these are there."""
    number, held, opening = TaskContext.get().partitionId() << 32, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        begins = _begins(held.column("conv_id").combine_chunks())
        if opening and len(begins) > 1:
            for part in _pieces(held.slice(0, begins[1])):
                yield _piece(part, number)
                number += 1
            held, begins, opening = held.slice(begins[1]), begins[1:] - begins[1], False
        if len(begins) > 1:
            yield _repair(held.slice(0, begins[-1]))
            held = held.slice(begins[-1])
        if held.num_rows >= PIECE_ROWS or held.column("text").nbytes > PIECE_BYTES:
            # What follows of this conversation belongs to pieces too.
            for part in _pieces(held):
                yield _piece(part, number)
                number += 1
            held, opening = held.slice(0, 0), True
    if held is not None and held.num_rows:
        for part in _pieces(held):
            yield _piece(part, number)
            number += 1


def _repeated(size: int, fresh: list[int] | None) -> np.ndarray:
    out = np.ones(size, dtype=bool)
    out[np.array(fresh or [], dtype=np.int64)] = False
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's matrix of costs from and to the structural states, and its counts."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            looks, copies = np.array(row["looks"], dtype=np.int64), np.array(row["copies"], dtype=np.int64)
            repeated, one = _repeated(len(looks), row["fresh"]), np.array([0])
            kinds = kinds_of(looks, repeated)
            matrix = np.full((4, 4), FAR)
            for to in range(4):
                _, state, cost = TABLE.scan(kinds, copies - 1, one, TABLE.state([0 if q == to else FAR for q in range(4)])[0])
                matrix[:, to] = [FAR if v >= FAR else v + cost[0] for v in TABLE.vectors[state[0]]]
            found = structure(looks, copies, repeated, one, pa.array(row["turns"], pa.int64()))
            out.append({"conv_id": row["conv_id"], "piece": row["piece"], "matrix": matrix.reshape(-1).tolist(), "head": int(looks[0] & 3), "tail": int(looks[-1] & 3), "first": str(row["turns"][0]), "last": str(row["turns"][-1]), **{k: int(v[0]) for k, v in found.items()}})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("matrix", pa.list_(pa.int64()))] + [("first", pa.string()), ("last", pa.string())] + [(c, pa.int64()) for c in ("head", "tail", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns")]))


_SUMMARY = "conv_id long, piece long, matrix array<long>, first string, last string, head long, tail long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"


def _compose(pieces: pd.DataFrame) -> pd.DataFrame:
    """Costs to go behind each piece of a conversation; its counts stand at its first piece."""
    pieces = pieces.sort_values("piece").reset_index(drop=True)
    after = np.array(TABLE.vectors[TABLE.end()], dtype=np.int64)
    total, behind = 0, []
    for matrix in reversed(pieces["matrix"].tolist()):
        behind.append(after.tolist())
        before = np.minimum((np.array(matrix).reshape(4, 4) + after[None, :]).min(axis=1), FAR)
        total += int(before.min())
        after = np.where(before < FAR, before - before.min(), FAR)
    head, tail = pieces["head"].to_numpy()[1:], pieces["tail"].to_numpy()[:-1]
    seams = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(tail, head, strict=True))
    first, last = pieces["first"].to_numpy()[1:], pieces["last"].to_numpy()[:-1]
    turns = int(pieces["turns"].sum()) - sum(a == b != "None" for a, b in zip(first, last, strict=True))
    out = pd.DataFrame({"piece": pieces["piece"], "after": behind[::-1]})
    sums = {c: int(pieces[c].sum()) for c in ("blank", "duplicate", "truncated")} | {"illegal": int(pieces["illegal"].sum()) + seams, "gaps": int(gaps(pieces["low"].min(), pieces["high"].max(), turns)), "cost": total + int(after[0])}
    for c in _COUNTS:
        out[c] = pd.Series([sums[c]] + [None] * (len(out) - 1), dtype="Int64")
    return out


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves of each row of a piece, as letters, from each structural state, and where that leads."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            looks, copies, one = np.array(row["looks"], dtype=np.int64), np.array(row["copies"], dtype=np.int64), np.array([0])
            kinds = kinds_of(looks, _repeated(len(looks), row["fresh"]))
            behind, _, _ = TABLE.scan(kinds, copies - 1, one, TABLE.state(row["after"])[0])
            traced = [TABLE.trace(kinds, behind, one, q) for q in range(4)]
            out.append({"conv_id": row["conv_id"], "piece": row["piece"], **{c: row[c] for c in _COUNTS}, "letters": [[TABLE.moves[m][0] for m in moves] for moves, _ in traced], "exits": [int(q[0]) for _, q in traced], "roles": row["roles"], "texts": row["texts"], "copies": row["copies"]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("piece", pa.int64())] + [(c, pa.int64()) for c in _COUNTS] + [("letters", pa.list_(pa.list_(pa.string()))), ("exits", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64()))]))


_TRACED = "conv_id long, piece long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", letters array<array<string>>, exits array<int>, roles array<string>, texts array<string>, copies array<long>"


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each conversation in order: the text goes through SHA-256 piece by piece, letters are put together."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    row, audit, digest, q, said = None, [], None, 0, False

    def say(lines):
        nonlocal said
        for line in lines:
            digest.update((("\n" if said else "") + line).encode("utf-8"))
            said = True

    def closed():
        say(edited(TAILS[q], q, "", ""))
        return pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], **{c: row[c] for c in _COUNTS}, "audit": "".join(audit) + TAILS[q], "repaired_sha256": digest.hexdigest()}], schema)

    for batch in batches:
        for n in range(batch.num_rows):
            piece = batch.slice(n, 1).to_pylist()[0]
            if row is None or piece["conv_id"] != row["conv_id"]:
                if row is not None:
                    yield closed()
                row, audit, digest, q, said = piece, [], hashlib.sha256(), 0, False
            state = q
            for letters, role, text, copies in zip(piece["letters"][q], piece["roles"], piece["texts"], piece["copies"], strict=True):
                say(edited(letters, state, role, text))
                for letter in letters:
                    state = state if letter == "D" else DUE_NEXT[state] if letter in "IR" else BEHIND[state][INITIALS.index(role[0])]
                audit.append(letters + "D" * (copies - 1))
            q = piece["exits"][q]
    if row is not None:
        yield closed()


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation among
    ``rows`` (``conv_id, turn, role, text, copies``, as ``damage`` gives them; role and text without nulls).

    Rows of a conversation are taken by turn, nulls first, then by role and text; ``copies`` equal rows stand side by
    side. A null conv_id is a conversation of its own. Faults of a row: blank, else a duplicate of role and text seen
    before it, else truncated. Conversations without rows are not here: ``repair_all`` has them."""
    scanned = materialize(sorted_rows(rows).mapInArrow(_scan_partition, _SCANNED))
    results = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    pieces = scanned.where("piece is not null").select("conv_id", "piece", *_ROWS)
    # Where each role and text stands first: combined before the shuffle, so one that fills a conversation is no hot key.
    said = pieces.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "row"))
    firsts = said.groupBy("conv_id", F.sha2(F.concat_ws(":", "row.roles", "row.texts"), 256).alias("mark"), F.length("row.roles").alias("cut")).agg(F.min(F.struct("piece", "pos")).alias("m"))
    fresh = firsts.groupBy(F.col("m.piece").alias("piece")).agg(F.collect_list("m.pos").alias("fresh"))
    marked = materialize(pieces.join(fresh.hint("merge"), "piece", "left"))  # a piece's number is its own in the whole table
    summed = marked.mapInArrow(_summaries, _SUMMARY)
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    composed = summed.groupBy("conv_id").applyInPandas(_compose, f"piece long, after array<long>, {counts}")
    traced = marked.join(composed.hint("merge"), "piece").mapInArrow(_traces, _TRACED)
    mended = traced.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_join_pieces, "conv_id long, " + counts + ", audit string, repaired_sha256 string")
    return scanned.where("piece is null").select(results).unionByName(mended.select(results))


def repair_all(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``repair`` of the damaged rows, and zeros, an empty audit and the empty text's hash for conversations that lost all.

    Null ids, turns, roles and texts, repeated rows, empty and very long texts and further columns are all taken; a table
    without rows gives none."""
    lost = rows.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    zeros = [F.lit(0).cast("long").alias(c) for c in _COUNTS]
    lost = lost.select("conv_id", *zeros, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
    found = materialize(repair(damage(rows, conv_col, turn_col, role_col, text_col)))
    return found.unionByName(lost.join(found.select(F.col("conv_id").alias("c")).hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti"))

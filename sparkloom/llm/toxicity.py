"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string of token classes: insult, threat, target (whom it is said to), negation, report (somebody
else's words) and other. Three mark transducers run over it, each one forwards and backwards, since a target may stand
before ("you are an ...") or behind ("..., you"). An arc carries the strength of the mark it leaves, which falls off with
distance:

    lexicon -> target -> negation -> reported speech -> score

The three are composed ahead of time into a forward and a backward machine (a bimachine): the states on both sides of an
insult or threat give a distribution over patterns such as "insult, aimed at someone, negated". A document's evidence is
the weight of its patterns over all clauses, and of its worst clause.

What a pattern is worth is learned from labels by a logistic model whose few parameters are what the marks mean: a plain
hit, a threat, what aiming adds, what negation and report take away. They are held to those meanings (reported, negated
<= plain <= aimed) and drawn towards prior values, so that a kind of pattern that the labelled texts hardly hold keeps a
sensible weight. The lexicon of insults is learned as well: words and word beginnings that are far more frequent in toxic
documents, besides a few seeds. Documents without a lexicon word (found by hashing all words of a batch at once) need no
machine: they score as an empty match. Those with characters beyond Latin-1 and general punctuation always go through it,
as the hashing reads no others."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import buffers, drop_table, materialize, smallest_by_hash, spread, text_slices

#: Bounds of the training sample and of what is kept of it.
TRAIN_DOCUMENTS, LEXICON_SIZE = 12_000, 500
#: Word beginnings that may be learned: characters, and bytes at least (so four letters of ASCII).
STEM_LENGTHS, STEM_BYTES = range(3, 10), 4
MIN_LIFT, MIN_SUPPORT, MIN_SHARE, MIN_PRECISION = 1.8, 3, 0.01, 0.4
#: A word must be unlikely to occur in toxic documents alone by chance, as if so many words had been tried.
TRIED = 100_000

# Seeds of the classes: common words of the languages at hand.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb vermin filth idiota estúpido imbécil dummkopf vollidiot trottel abschaum crétin ordure".split()
THREATS = "kill hurt destroy shoot stab strangle beat murder burn töten umbringen erschlagen tuer tuerai frapper frapperai matar mataré golpear golpearé".split()
TARGETS = "you your yours u he she they him her them du dich dir ihr euch sie tu te toi vous il elle ils tú te usted ustedes él ella eres".split()
NEGATIONS = "not never no without cannot don't isn't aren't won't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún sin".split()
REPORTS = "said says say call called calls wrote writes quoted claimed reportedly allegedly sagte sagt nannte schrieb dit disait écrit dijo dice escribió llamó".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

CLAUSE_END = re.compile(r"[.!?;:\n\r]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
MARKS = (TARGET, NEGATION, REPORT)
#: Strengths of a mark on the tokens before it and behind it, nearest first; a negation works forwards only.
AHEAD = {TARGET: (1.0, 1.0, 0.9, 0.8, 0.6), NEGATION: (1.0, 0.9, 0.8), REPORT: (1.0, 1.0, 1.0, 0.9, 0.9, 0.8, 0.7, 0.6)}
BEHIND = {TARGET: (1.0, 1.0, 0.6), NEGATION: (), REPORT: (1.0, 1.0, 0.9, 0.8)}
PATTERNS = 16


def compose(reach: dict[int, tuple[float, ...]]) -> tuple[list[list[int]], list[tuple[float, ...]]]:
    """The composed machine of one direction: the next state for each state and token class, and for each state the
    strengths of the marks on the token to be read. A part's state is the number of tokens its last mark still reaches."""
    number, states, step = {(0,) * len(MARKS): 0}, [(0,) * len(MARKS)], []
    for state in states:
        row = []
        for kind in range(6):
            after = tuple(len(reach[m]) if kind == m else max(0, left - 1) for m, left in zip(MARKS, state, strict=True))
            if after not in number:
                number[after] = len(number)
                states.append(after)
            row.append(number[after])
        step.append(row)
    return step, [tuple(reach[m][-left] if left else 0.0 for m, left in zip(MARKS, s, strict=True)) for s in states]


(FORWARD, FORWARD_MARKS), (BACKWARD, BACKWARD_MARKS) = compose(AHEAD), compose(BEHIND)


def _emit(kind: int, left: tuple[float, ...], right: tuple[float, ...]) -> tuple[tuple[int, float], ...]:
    """(pattern, share) of a hit between two states: each mark holds with the larger strength of the two sides."""
    out = {8 * (kind == THREAT): 1.0}
    for bit, strength in enumerate(map(max, left, right)):
        out = {p | on << bit: share * (strength if on else 1 - strength) for p, share in out.items() for on in (0, 1)}
    return tuple((p, share) for p, share in sorted(out.items()) if share > 1e-12)


def _fold(data: np.ndarray) -> np.ndarray:
    """Letters of Latin-1 beyond ASCII in lower case (A-Z are folded by the hash)."""
    if not (data >= 0x80).any():
        return data
    data = data.copy()
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    data[upper] += 0x20
    return data


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
#: Last bytes, behind C2, E2 80 and E2 81, of characters that TOKEN takes as letters (such as superscripts).
_ODD = {lead: np.array([bool(TOKEN.match((lead + bytes([b])).decode())) if 0x80 <= b < 0xC0 else False for b in range(256)]) for lead in (b"\xc2", b"\xe2\x80", b"\xe2\x81")}


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters: punctuation of Latin-1 (C2 xx, C3 97, C3 B7) and general punctuation (E2 80-81 xx) are none."""
    inside = _LETTER[data]
    two = np.flatnonzero((data == 0xC2) | ((data == 0xC3) & np.isin(np.append(data[1:], 0), (0x97, 0xB7))))
    three = np.flatnonzero((data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81)))
    for at, width in ((two, 2), (three, 3)):
        for i in range(width):
            inside[np.minimum(at + i, len(data) - 1)] = False
    return inside


def _unread(data: np.ndarray) -> np.ndarray:
    """Places of characters that ``_fold`` and ``_letters`` don't read as ``str.lower`` and TOKEN do."""
    lead = np.flatnonzero(data >= 0xC2)
    one, two = np.minimum(lead + 1, len(data) - 1), np.minimum(lead + 2, len(data) - 1)
    latin, mark = data[lead] == 0xC2, (data[lead] == 0xE2) & ((data[one] == 0x80) | (data[one] == 0x81))
    known = (data[lead] == 0xC3) | (latin & ~_ODD[b"\xc2"][data[one]])
    for third in (0x80, 0x81):
        known |= mark & (data[one] == third) & ~_ODD[bytes([0xE2, third])][data[two]]
    return lead[~known]


class Lexicon:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.kinds = {w: (k, 1.0) for k, group in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)) for w in group}
        self.kinds |= {w: (INSULT, v) for w, v in words.items()}
        self.stems = dict(stems)
        self.widths = sorted({len(s) for s in stems})
        hits = [w for w, (k, _) in self.kinds.items() if k in (INSULT, THREAT)]
        # Spans end at an apostrophe, so words and stems with one inside are looked for by what is before it.
        hits = sorted({re.split("['’]", w)[0] for w in hits} | {re.split("['’]", s)[0] for s in stems if re.search("['’]", s)})
        self.hashes = np.sort(self._hash(hits))
        self.stem_hashes = {n: np.sort(self._hash([s for s in stems if len(s.encode()) == n])) for n in sorted({len(s.encode()) for s in stems})}

    @staticmethod
    def _hash(words: list[str]) -> np.ndarray:
        data, offsets = buffers(pa.array(words, pa.string()))
        return tv.span_hashes(data, offsets[:-1], offsets[1:]) if words else np.zeros(0, np.uint64)

    @staticmethod
    def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(values), dtype=bool)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return known[at] == values

    def rows_with_hits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that can hold a hit: those where a span is one, and those with characters that spans don't read."""
        unread = np.unique(np.searchsorted(offsets, _unread(data), side="right") - 1)
        return np.union1d(unread, self._rows_of_spans(_fold(data), offsets))

    def _rows_of_spans(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, ends, first = tv.spans(_letters(data), offsets) if len(data) else (np.zeros(0, np.int64),) * 2 + (offsets,)
        if not len(starts):
            return np.zeros(0, np.int64)
        total = tv.totals(data)
        hit = self._among(tv.span_hash(total, starts, ends), self.hashes)
        for n, known in self.stem_hashes.items():
            long = np.flatnonzero(ends - starts >= n)
            hit[long] |= self._among(tv.span_hash(total, starts[long], starts[long] + n), known)
        return np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1)

    def read(self, token: str) -> tuple[int, float]:
        found = self.kinds.get(token)
        if found is not None:
            return found
        for n in self.widths:
            value = self.stems.get(token[:n])
            if value is not None:
                return INSULT, value
        return OTHER, 0.0

    def patterns(self, text: str) -> np.ndarray:
        """Weight of each pattern, summed over the clauses that hold one; the last entry is that of the clause with the
        most weight that is neither negated nor reported."""
        out, best = np.zeros(PATTERNS + 1), 0.0
        for clause in CLAUSE_END.split(text.lower()):
            read = [self.read(token) for token in TOKEN.findall(clause)]
            if not any(kind in (INSULT, THREAT) for kind, _ in read):
                continue
            right, state = [], 0
            for kind, _ in reversed(read):
                right.append(state)
                state = BACKWARD[state][kind]
            state, score = 0, 0.0
            for (kind, weight), back in zip(read, reversed(right), strict=True):
                if kind in (INSULT, THREAT):
                    for pattern, share in _emitted(kind, state, back):
                        out[pattern] += weight * share
                        score += weight * share * (not pattern & 6) * (pattern != 8)
                state = FORWARD[state][kind]
            best = max(best, score)
        out[:PATTERNS] = np.minimum(out[:PATTERNS], 6.0)
        out[PATTERNS] = min(best, 6.0)
        return out


@lru_cache(maxsize=None)
def _emitted(kind: int, left: int, right: int) -> tuple[tuple[int, float], ...]:
    return _emit(kind, FORWARD_MARKS[left], BACKWARD_MARKS[right])


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        margin = np.full(len(texts), self.bias)
        for i in self.lexicon.rows_with_hits(*buffers(texts)):
            margin[i] += self.lexicon.patterns(texts[int(i)].as_py() or "") @ self.weights
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


#: What the parameters are drawn to: a plain hit, a threat at somebody, what aiming adds, what negation and report leave
#: out (as shares of the hit), and the worst clause.
PRIOR = {"hit": 1.8, "threat": 4.5, "aimed": 0.8, "negated": 0.8, "reported": 0.6, "clause": 0.5}
#: A threat word at nobody ("to beat the eggs") is worth this share of one at somebody.
BARE_THREAT = 0.15


def pattern_weights(hit: float, threat: float, aimed: float, negated: float, reported: float, clause: float) -> np.ndarray:
    """The weight of each pattern from what its marks mean, and that of the worst clause."""
    out = []
    for p in range(PATTERNS):
        plain = (threat + aimed if p & 1 else BARE_THREAT * threat) if p & 8 else hit + aimed * (p & 1)
        out.append(plain * (1 - negated * bool(p & 2)) * (1 - reported * bool(p & 4)))
    return np.array([*out, clause])


def default_model() -> ToxicityModel:
    """Without labels: the seeds, and the prior weights."""
    return ToxicityModel(Lexicon({}, {}), pattern_weights(**PRIOR), -4.0)


def _features(text: str) -> set[str]:
    """Words, and beginnings (written with a trailing hyphen), of a text."""
    words = set(TOKEN.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in STEM_LENGTHS if len(w) > n and len(w[:n].encode()) >= STEM_BYTES}


def _sketches(texts: pa.Array) -> list[tuple[int, int]]:
    """Two min-hashes of each text's words, by which copies are told."""
    data, offsets = buffers(texts)
    starts, ends, first = tv.word_spans(data, offsets)
    words = tv.span_hashes(data, starts, ends)
    sets = [tv.shingle_hashes(words[a:b], 3) for a, b in zip(first, first[1:])]
    return [(int(s[0] >> np.uint64(1)), int(tv.mix(s).min() >> np.uint64(1))) if len(s) else (0, 0) for s in sets]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            rows = _sketches(batch.column(1).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["id", "x", "y"])


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (id, text, label, x, y) those whose text has the sketch x, y."""
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            part = batch.slice(a, b - a)
            same = [s == (x, y) for s, x, y in zip(_sketches(part.column(1)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
            yield part.filter(pa.array(same, pa.bool_())).select([0, 1, 2])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist(), strict=True):
                (toxic if label else clean).update(_features(text or ""))
            names = list({**toxic, **clean})
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([clean[w] for w in names], pa.int64())], names=["feature", "t", "c"])


def choose_lexicon(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """Words and beginnings by lift; a word or beginning that a chosen beginning covers is left out."""
    support = max(MIN_SUPPORT, math.ceil(MIN_SHARE * toxic))
    by_chance = lambda t, c: TRIED * math.comb(t + c, c) * (toxic / (toxic + clean)) ** t
    found = []
    for name, t, c in rows:
        lift = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if t >= support and lift >= MIN_LIFT and t >= MIN_PRECISION * (t + c) and by_chance(t, c) < 1:
            found.append((t, t - 3 * c, len(name), name, min(lift, 6.0) / 3))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    reach: dict[str, int] = {}  # beginnings of chosen names, and the most toxic texts that one of these names reaches
    for t, _, _, name, weight in sorted(found, key=lambda x: (-x[1], -x[2], x[3]))[: 20 * LEXICON_SIZE]:
        plain = name.removesuffix("-")
        covered = any(plain[:n] in stems for n in range(1, len(plain) + 1))
        # A shorter beginning that reaches no more texts than a chosen name below it says nothing new.
        if covered or reach.get(plain, 0) >= t or len(words) + len(stems) >= LEXICON_SIZE:
            continue
        (stems if name.endswith("-") else words)[plain] = weight
        for n in range(1, len(plain) + 1):
            reach[plain[:n]] = max(reach.get(plain[:n], 0), t)
    return Lexicon(words, stems)


def _patterns(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            part = batch.slice(a, b - a)
            rows = [lexicon.patterns(t or "").tolist() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64())), part.column(2)], names=["id", "x", "label"])


def learn_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Pattern weights and bias of the most likely parameters around PRIOR, by gradient steps within their bounds."""
    names = list(PRIOR)
    prior = np.array([PRIOR[n] for n in names])
    least, most = np.array([0.3, 2.0, 0.1, 0.2, 0.2, 0.1]), np.array([6.0, 8.0, 4.0, 1.0, 1.0, 4.0])
    theta, bias, speed, step = prior.copy(), -3.0, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for i in range(1, rounds + 1):
        w = pattern_weights(*theta)
        error = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        slope = x.T @ error
        grad = np.empty(len(names) + 1)
        for k in range(len(names)):
            moved = theta.copy()
            moved[k] += 1e-4
            grad[k] = slope @ (pattern_weights(*moved) - w) / 1e-4 + ridge * (theta[k] - prior[k])
        grad[-1] = error.sum() + 1e-3 * bias
        step += 0.1 * (grad - step)
        speed += 0.01 * (grad * grad - speed)
        move = 0.05 * (1 - i / (rounds + 1)) * (step / (1 - 0.9**i)) / (np.sqrt(speed / (1 - 0.99**i)) + 1e-8)
        theta, bias = np.clip(theta - move[:-1], least, most), bias - move[-1]
    return pattern_weights(*theta), float(bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, train_filter, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from at most ``TRAIN_DOCUMENTS`` labelled documents, those whose id hashes lowest; of copies among them, and
    of rows of one id, one counts. The driver gets LEXICON_SIZE words and 17 numbers a document."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & train_filter(F.col("id")))
    chosen = smallest_by_hash(known.groupBy("id").agg(F.max("label").alias("label")), "id", TRAIN_DOCUMENTS, 13)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"))
    rows = materialize(rows)
    # Of several texts of an id the lowest hash counts, so what is collected below is TRAIN_DOCUMENTS rows at most.
    sketched = rows.mapInArrow(_sketch, "id long, x long, y long").groupBy("id").agg(F.min(F.struct("x", "y")).alias("s"))
    seen, ids = set(), []
    for r in sorted((r["s"]["x"], r["s"]["y"], r["id"]) for r in sketched.collect()):
        if ("x", r[0]) not in seen and ("y", r[1]) not in seen:
            ids.append((r[2], r[0], r[1]))
        seen |= {("x", r[0]), ("y", r[1])}
    if not ids:
        drop_table(rows)
        return default_model()
    picked = rows.sparkSession.createDataFrame(ids, "id long, x long, y long")
    sample = materialize(rows.join(F.broadcast(picked), "id").mapInArrow(_picked, "id long, text string, label int").dropDuplicates(["id"]))
    drop_table(rows)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        drop_table(sample)
        return default_model()
    features = sample.mapInArrow(_count, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    support = max(MIN_SUPPORT, math.ceil(MIN_SHARE * toxic))
    best = features.where((F.col("t") >= support) & (F.col("t") >= MIN_PRECISION * (F.col("t") + F.col("c")))).orderBy(F.desc(F.col("t") - 3 * F.col("c")), F.desc(F.length("feature")), "feature").limit(20 * LEXICON_SIZE)
    lexicon = choose_lexicon([(r["feature"], r["t"], r["c"]) for r in best.collect()], toxic, clean)
    found = sorted((r["id"], r["x"], r["label"]) for r in sample.mapInArrow(partial(_patterns, lexicon=lexicon), "id long, x array<double>, label int").collect())
    drop_table(sample)
    weights, bias = learn_weights(np.array([x for _, x, _ in found]), np.array([float(y) for _, _, y in found]))
    return ToxicityModel(lexicon, weights, bias)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(batch.column(1).slice(a, b - a)), pa.float64())], names=["id", "score"])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` (0 to 1) for each row, in no shuffle. Null and empty texts, and texts without any insult or
    threat, score as an empty match. Repeated rows get equal scores; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_SIZE words and a few numbers
    wanted = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return wanted.mapInArrow(partial(_score, model=shared), "id long, score double").withColumnRenamed("id", id_col)

"""What clauses mean to the grammar, what the grammar adds to a count of lexicon words, and rows in odd tables."""

import zlib

import numpy as np
import pytest

from sparkloom.llm import toxicity
from sparkloom.llm.common import crc32_mod

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.fit(*tables, "toxic", lambda i: crc32_mod(i, 4) != 2)


def weight(model, text):
    return model.lexicon.patterns(text) @ model.weights


CLAUSES = [
    # plain, aimed before, aimed behind, negated, reported
    ("what a moron", "you are a moron", "moron, you", "he is not a moron", "she said he is a moron"),
    ("ein vollidiot", "du bist ein vollidiot", "vollidiot, du", "kein vollidiot", "er sagte vollidiot"),
    ("un crétin", "tu es un crétin", "crétin, toi", "jamais un crétin", "il a dit crétin"),
    ("un idiota", "tú eres un idiota", "idiota, tú", "nunca un idiota", "dijo que es un idiota"),
]


@pytest.mark.parametrize("clauses", CLAUSES)
def test_marks_in_four_languages(model, clauses):
    plain, before, behind, negated, reported = (weight(model, c) for c in clauses)
    assert before > plain and behind > plain
    assert 0 <= negated < plain and 0 <= reported < before


@pytest.mark.parametrize("threat", ["i will kill you", "ich will dich töten", "je vais te frapper", "voy a matar a usted"])
def test_threats_need_no_insult(model, threat):
    import pyarrow as pa

    scores = model.score(pa.array([threat, "kill the lights", "we will not hurt you", "nothing at all"]))
    assert scores[0] >= 0.3 and scores[1] < 0.3 and scores[2] < scores[0] and scores[3] < 0.3


def test_weights_keep_their_meanings(model):
    w = model.weights
    assert w[1] > w[0] > w[2] >= 0 and w[0] > w[4] >= 0 and w[1] > w[3] and w[1] > w[5] and w[9] > w[8] > 0
    assert all(w[p | 6] <= min(w[p | 2], w[p | 4]) for p in (0, 1, 8, 9))


def test_composed_machines_equal_marks_one_by_one():
    """Strengths of the bimachine against a loop over all marks of a clause."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        kinds = rng.integers(0, 6, 12).tolist()
        left, right = [0], [0]
        for k in kinds:
            left.append(toxicity.FORWARD[left[-1]][k])
        for k in reversed(kinds):
            right.append(toxicity.BACKWARD[right[-1]][k])
        for at, kind in enumerate(kinds):
            if kind not in (toxicity.INSULT, toxicity.THREAT):
                continue
            want = []
            for mark in toxicity.MARKS:
                ahead, behind = toxicity.AHEAD[mark], toxicity.BEHIND[mark]
                before = next((ahead[at - i - 1] for i in range(at - 1, -1, -1) if kinds[i] == mark and at - i <= len(ahead)), 0.0)
                after = next((behind[i - at - 1] for i in range(at + 1, len(kinds)) if kinds[i] == mark and i - at <= len(behind)), 0.0)
                want.append(max(before, after))
            got = dict(toxicity._emitted(kind, left[at], right[len(kinds) - 1 - at]))
            assert abs(sum(got.values()) - 1) < 1e-9
            for bit, strength in enumerate(want):
                assert abs(sum(v for p, v in got.items() if p >> bit & 1) - strength) < 1e-9


def test_the_grammar_adds_to_a_count_of_words(model, tables):
    docs, labels = tables
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows]
    x = np.array([model.lexicon.patterns(r.text or "") for r in rows])
    y, held = np.array([r.toxic for r in rows]), np.array(held)
    count = x[:, :16].sum(axis=1)
    # Both get the threshold that does best on training rows, and are judged on rows neither has seen.
    wrong = {}
    for name, value in (("count", x[:, :16].sum(axis=1)), ("grammar", x @ model.weights)):
        cut = min(np.unique(value[~held]), key=lambda c: ((value >= c) != (y == 1))[~held].sum())
        wrong[name] = int(((value >= cut) != (y == 1))[held].sum())
    mine = (x @ model.weights + model.bias) >= np.log(0.3 / 0.7)
    print("held out, wrong:", wrong, "toxic", y[held].sum(), "found at 0.3", (mine & (y == 1))[held].sum(), "false", (mine & (y == 0))[held].sum())
    assert wrong["grammar"] <= wrong["count"]


def test_repeated_ids_and_clashing_names(spark):
    texts = ["you utter scum of a moron", "a fine day in the hills", "what a clown and a loser", "rain fell on the old mill"]
    rows = [(i, texts[i % 4] + f" number{i}", i % 2, "x", i) for i in range(80)] + [(0, "another text of an id", 0, "x", 0), (None, "idiot", 1, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, id string, toxic int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)] + [(3, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels, "toxic", lambda i: i >= 0)
    got = toxicity.score(docs, fitted)
    assert got.columns == ["doc_id", "score"] and got.count() == len(rows)
    scores = {r.doc_id: r.score for r in got.collect() if r.doc_id}
    assert np.mean([(scores[i] >= 0.3) == (i % 2 == 0) for i in range(1, 80)]) > 0.9

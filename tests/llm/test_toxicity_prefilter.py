"""No text that the toxicity grammar matches is passed over by the search for lexicon words."""

import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import toxicity

LEXICON = toxicity.Lexicon({"дурак": 1.0, "głupek": 1.0, "don't": 2.0, "m²k": 1.0, "o’brien": 1.0}, {"schwach": 1.0, "d'ab": 1.0, "ähn": 1.5})


def test_every_match_is_scored():
    words = ["idiot", "IDIOT", "moron", "scum", "дурак", "ДУРАК", "GŁUPEK", "Don't", "x'don't", "m²k", "O’Brien", "SCHWACHKOPF", "d'abord", "ÄHNLICH", "you", "plain", "Kill", "TÖTEN"]
    ends = [" ", "😡", "€", "！", "→", "×", "÷", "²", "ª", "ⁿ", "‿", "、", "’", "'", "_", "7", "́", "é", "…", "\x00"]
    rng = random.Random(5)
    texts = [a + w + b for w in words for a in ends for b in ends] + ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(5))) for _ in range(2000)] + ["", "Ã", "â€", "idiot😡", None]
    model = toxicity.ToxicityModel(LEXICON, np.arange(1.0, toxicity.PATTERNS + 2), -3.0)
    wanted = [LEXICON.patterns(t or "") @ model.weights + model.bias for t in texts]
    assert np.allclose(model.score(pa.array(texts)), 1 / (1 + np.exp(-np.clip(wanted, -30, 30))))

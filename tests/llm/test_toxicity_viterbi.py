"""Viterbi decoding against every reading of short tokens, and long tokens."""

import itertools
import random

import numpy as np
from test_llm_operators import _trigrams

from vigil.llm import toxicity

TEXT = "the stupid idiot saw a loser and a moron in the trash with an idiot and a pathetic clown ugly fool " * 40


def best_reading(model, lattice):
    """The best of all readings, by trying each."""
    best = None
    for reading in itertools.product(*lattice):
        text, score = "".join(t for t, _ in reading), sum(c for _, c in reading)
        x = y = 0
        for ch in text + " ":
            z = toxicity._CODE.get(ch, 0)
            score += model.table[x, y, z]
            x, y = y, z
        if best is None or score > best[0]:
            best = score, text
    return best


def test_decoding_is_the_best_of_all_readings():
    model = toxicity.CharacterModel(_trigrams(TEXT))
    rng = random.Random(6)
    tokens = ["st*pid", "f*ol", "*dio", "a**", "f00l", "$tup!d", "l0000s", "id.i0t", "u-g-ly", "c|own", "tr4$h", "*a*"]
    tokens += ["".join(rng.choice("aeilost0134$!.-*") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    tried = 0
    for token in tokens:
        lattice = toxicity._lattice(token)
        if np.prod([len(p) for p in lattice]) > 30000:
            continue
        want, got = best_reading(model, lattice), model.decode(lattice)
        assert abs(want[0] - got[0]) < 1e-9, (token, want, got)
        tried += 1
    assert tried > 80


def test_long_tokens_are_restored():
    r = toxicity.Restorer(toxicity.CharacterModel(_trigrams(TEXT)))
    for shown, meant in (("p...a...t...h...e...t...i...c", "pathetic"), ("sssssttttuuuuppppiiiidddd", "stupid"), ("i-----d-----i-----o-----t" + "!" * 40, "idiot")):
        assert meant in r.words(f"you {shown} there"), shown
    long = "x" + "*" * 3 + "y1" * 4000
    assert r.words(long)

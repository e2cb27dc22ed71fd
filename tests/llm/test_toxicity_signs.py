"""Disguised words whose first or last letters are signs, and long ones."""

import pytest
from test_llm_operators import _trigrams

from vigil.llm import toxicity


@pytest.fixture(scope="module")
def restorer():
    text = "the stupid idiot saw a shit and an ass in the trash and that ass is a disgusting clown in the street " * 40
    return toxicity.Restorer(toxicity.CharacterModel(_trigrams(text)))


@pytest.mark.parametrize("shown,meant", [("$tup!d", "stupid"), ("!d!ot", "idiot"), ("a$$", "ass"), ("@$$", "ass"), ("shi+", "shit"), ("(lown", "clown")])
def test_edge_signs(restorer, shown, meant):
    for around in ("you {} there", "you {}!", '"{}," he said', "({})"):
        assert meant in restorer.words(around.format(shown)), (around, shown)


def test_punctuation_stays_none(restorer):
    assert {"stupid", "clown"} <= restorer.words("(stupid clown!)")
    assert restorer.words("The street! (idiot)") >= {"the", "street", "idiot"}


@pytest.mark.parametrize("shown,meant", [("d--i--s--g--u--s--t--i--n--g", "disgusting"), ("stu" + "u" * 24 + "pid", "stupid"), ("1d10t/" + "$tup!d/" * 3 + "tr4sh", "trash")])
def test_long_words(restorer, shown, meant):
    assert len(shown) > 24 and meant in restorer.words(f"a {shown} one")


def test_very_long_token(restorer):
    assert len(restorer.words("x1" * 30000)) >= 1 and all(len(t) <= 64 for t in restorer.seen)


def test_wide_steps_are_exact(restorer):
    tokens = ["s***id", "***pid", "clo***", "**a***b", "i***t!", "tr**h***"]
    wide = [restorer.model.decode(toxicity._lattice(t)) for t in tokens]

    def plain(lattice):  # narrow steps only: each letter of a position in its own pass
        log, states = restorer.model.log, {(0, 0): 0.0}
        for choices in [*lattice, [(" ", 0.0)]]:
            after = {}
            for (a, b), score in states.items():
                for text, cost in choices:
                    s, x, y = score + cost, a, b
                    for ch in text:
                        z = toxicity._CODE.get(ch, 0)
                        s, x, y = s + log[x][y][z], y, z
                    after[x, y] = max(after.get((x, y), -1e300), s)
            states = after
        return max(states.values())

    assert [round(s, 9) for s, _ in wide] == [round(plain(toxicity._lattice(t)), 9) for t in tokens]


@pytest.mark.parametrize("shown,meant", [("st***d", "stupid"), ("st****d", "stupid"), ("i**ot", "idiot"), ("stu$$$$pid", "stupid"), ("idi000000t", "idiot"), ("sh!!!!!t", "shit")])
def test_runs_of_any_length(restorer, shown, meant):
    assert meant in restorer.words(f"a {shown} one"), restorer.words(f"a {shown} one")


@pytest.mark.parametrize("shown,meant", [("a s s", "ass"), ("a.s.s", "ass"), ("s h i t", "shit"), ("i d i o t", "idiot")])
def test_single_characters_apart(restorer, shown, meant):
    assert meant in restorer.words(f"the {shown} there")
    assert restorer.words("a i the street")  # two letters that make no word are no reason to fail


def test_long_bars_are_linear(restorer):
    import time

    began = time.perf_counter()
    restorer.words("a" + "*" * 3000 + "b")
    assert time.perf_counter() - began < 20

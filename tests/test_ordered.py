"""Ordered replacement by an automaton against going through the table."""

import random
import re

import pytest

from nothi.functions import ordered
from nothi.functions.ordered import Replacer, replaced


def through(s, pairs, whole=False, letters="a-z"):
    n = 0
    for bad, good in pairs:
        if bad and bad != good:
            then = re.sub(f"(?<![{letters}]){re.escape(bad)}(?![{letters}])", lambda m: good, s) if whole else s.replace(bad, good)
            n, s = n + (then != s), then
    return s, n


@pytest.mark.parametrize("seed", range(6))
def test_as_the_whole_table(seed):
    rng = random.Random(seed)
    word = lambda least, most, of="abcd": "".join(rng.choices(of, k=rng.randint(least, most)))
    for _ in range(150):
        pairs = [(word(1, 4), word(0, 4)) for _ in range(rng.randint(0, 40))]
        s = word(0, 60, "abcd  ")
        assert Replacer(pairs)(s) == through(s, pairs)
        whole = [(word(1, 3, "ab"), word(0, 3, "ab ")) for _ in range(rng.randint(0, 30))]
        assert Replacer(whole, whole_words=True, letters="a-z")(s) == through(s, whole, True)


def test_long_texts_are_looked_through_around_changes():
    rng = random.Random(9)
    pairs = [(f"{a}{b}", f"{b}{a}{a}") for a in "abcdefgh" for b in "abcdefgh" if a != b] + [("zz", ""), ("xy", "zz")]
    s = "".join(rng.choices("abcdefgh        ", k=30_000)) + "xyxzzy"
    assert Replacer(pairs)(s) == through(s, pairs)


def test_chains_removals_and_repeated_entries():
    assert Replacer([("a", "b"), ("b", "c"), ("c", "d")])("a")== ("d", 3)
    assert Replacer([("b", "c"), ("a", "b")])("a") == ("b", 1)
    assert Replacer([("x", ""), ("ab", "Y"), ("Y", "ab"), ("ab", "Z")])("axb") == ("Z", 4)
    assert Replacer([])("a") == ("a", 0) and Replacer([("", "x"), ("a", "a")])("a") == ("a", 0)


def test_column(spark):
    d = spark.createDataFrame([(1, "করিম আলি"), (2, None), (3, "")], "i int, s string")
    got = {r.i: (r.r.text, r.r.n) for r in d.select("i", replaced("s", [("আলি", "আলী"), ("করিম", "রহিম")], whole_words=True).alias("r")).collect()}
    assert got == {1: ("রহিম আলী", 2), 2: ("", 0), 3: ("", 0)}


def test_texts_with_many_entries_go_through_the_table(monkeypatch):
    rng = random.Random(6)
    pairs = [("".join(rng.choices("abcd", k=rng.randint(1, 3))), "".join(rng.choices("abcd", k=rng.randint(0, 3)))) for _ in range(60)]
    texts = ["".join(rng.choices("abcd ", k=rng.randint(0, 300))) for _ in range(200)]
    replacer = ordered.Replacer(pairs)
    found = [replacer(t) for t in texts]
    assert found == [through(t, pairs) for t in texts]
    dense = ordered.Replacer(pairs)
    # No entry was looked for by itself, with the places of its changes.
    dense("".join(rng.choices("abcd", k=3000)))
    assert not dense.rules
    monkeypatch.setattr(ordered, "DENSE", 0)  # never
    assert found == [ordered.Replacer(pairs)(t) for t in texts]

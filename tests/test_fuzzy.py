"""The index finds what comparing every word with every entry finds."""

import random

import pytest
from pyspark.sql import functions as F

from nothi.functions.bengali import skeleton
from nothi.operators import correct, fuzzy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def alike(a, b):
    n = max(len(a), len(b))
    return 1.0 if n == 0 else 1.0 - distance(a, b) / n


def every(word, key, entries, keys, threshold, phonetic, margin):
    best = (None, threshold, "NONE")
    for e, k in zip(entries, keys):
        if alike(word, e) > best[1]:
            best = (e, alike(word, e), "LEVENSHTEIN")
        if phonetic and alike(key, k) > best[1] + margin:
            best = (e, alike(key, k), "PHONETIC")
    return best


def texts(rng, n, letters, most):
    return list(dict.fromkeys("".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(n)))


def keys_of(spark, words):
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", skeleton("w").alias("k")).collect()
    return [r.k for r in sorted(rows)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.75, 0.8, 0.9, 1.0])
def test_direct(spark, threshold):
    rng = random.Random(int(threshold * 100))
    entries, words = texts(rng, 120, "abc", 13), texts(rng, 150, "abc", 15)
    got = {r.w: (r.match, round(r.score, 9)) for r in fuzzy.best_match(spark.createDataFrame([(w,) for w in words], "w string"), "w", entries, threshold).collect()}
    for w in words:
        match, score, _ = every(w, "", entries, entries, threshold, False, 0)
        assert got[w] == (match, round(score, 9)), w


@pytest.mark.parametrize("threshold, margin", [(0.7, 0.05), (0.75, 0.0), (0.6, 0.1)])
def test_by_sound(spark, threshold, margin):
    rng = random.Random(3)
    letters = "করমসশািীে"
    entries, words = texts(rng, 90, letters, 10), texts(rng, 120, letters, 11)
    keys, word_keys = keys_of(spark, entries), keys_of(spark, words)
    got = {r._w: (r.match, round(r.score, 9), r.method) for r in fuzzy.best_match(spark.createDataFrame([(w,) for w in words], "_w string"), "_w", entries, threshold, phonetic=True, margin=margin).collect()}
    for w, k in zip(words, word_keys):
        match, score, method = every(w, k, entries, keys, threshold, True, margin)
        assert got[w] == (match, round(score, 9), method), w


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 1.0])
def test_tables(spark, threshold):
    rng = random.Random(int(threshold * 100) + 1)
    entries, words = texts(rng, 150, "abc", 15), texts(rng, 150, "abc", 15)
    listed = spark.createDataFrame(list(enumerate(entries)), "o int, entry string")
    got = {r.w: (r.match, round(r.score, 9)) for r in fuzzy.best_match(spark.createDataFrame([(w,) for w in words], "w string"), "w", listed, threshold).collect()}
    for w in words:
        match, score, _ = every(w, "", entries, entries, threshold, False, 0)
        assert got[w] == (match, round(score, 9)), w


def test_tables_nulls_and_places(spark):
    words = spark.createDataFrame([("abcd",), (None,), ("zzzz",)], "w string")
    entries = spark.createDataFrame([(2, "abcx"), (1, "abcy"), (0, None)], "o int, entry string")
    got = {r.w: r.match for r in fuzzy.best_match(words, "w", entries, 0.5).collect()}
    assert got == {"abcd": "abcy", None: None, "zzzz": None}
    assert {r.w: r.match for r in fuzzy.best_match(words, "w", entries.drop("o"), 0.5).collect()}["abcd"] == "abcx"
    assert fuzzy.best_match(words, "w", entries.limit(0), 0.5).filter("match is null").count() == 3


def test_bounds(spark):
    words = spark.createDataFrame([("a",)], "w string")
    with pytest.raises(ValueError):
        fuzzy.best_match(words, "w", ["x"] * (fuzzy.MOST + 1), 0.5)
    with pytest.raises(ValueError):
        fuzzy.best_match(words, "w", ["x"], 0.0)
    with pytest.raises(ValueError):
        fuzzy.looked_up(words, "w", {str(i): "x" for i in range(fuzzy.MOST + 1)}, "o")


def test_large_lookups_stay_out_of_the_plan(spark):
    entries = [f"entry{i:05d}" for i in range(fuzzy.MOST)]
    words = spark.createDataFrame([("entry00007",), ("entri00009",)], "w string")
    found = fuzzy.best_match(words, "w", entries, 0.75)
    assert "entry0" not in found._jdf.queryExecution().toString()
    assert {r.w: r.match for r in found.collect()}["entry00007"] == "entry00007"
    given = correct.correct_words(words, "w", [(e, e) for e in entries], [])
    assert "entry0" not in given._jdf.queryExecution().toString()
    # The one-letter misspelling is as near to several entries; the first wins.
    assert {r.w: (r.corrected, r.method) for r in given.collect()} == {"entry00007": ("entry00007", "EXACT_DICTIONARY"), "entri00009": ("entry00009", "FUZZY_MATCH")}


def test_candidates_are_few(spark):
    rng = random.Random(5)
    words = spark.createDataFrame([("".join(rng.choices("abcdefghijklmnopqrst", k=9)),) for _ in range(2000)], "w string").distinct()
    entries = fuzzy.entries_table(spark, words.select(F.col("w").alias("entry")))
    n = words.count()
    pairs = fuzzy.alike(words, "w", entries, "entry", 0.75, ("w",), ("o",)).distinct().count()
    assert n <= pairs < n * n / 50


def test_candidates_share_more_than_a_few_letters(spark):
    rng = random.Random(6)
    parts = "an en on ti re ha he th er nd st al".split()
    words = spark.createDataFrame([("".join(rng.choices(parts, k=5)),) for _ in range(3000)], "w string").distinct()
    entries = fuzzy.entries_table(spark, words.select(F.col("w").alias("entry")))
    found = fuzzy.alike(words, "w", entries, "entry", 0.75, ("w",), ("entry",)).distinct()
    near = found.filter("levenshtein(w, entry) <= 2").count()
    assert near <= found.count() < 15 * near


def test_what_words_ask_is_not_aggregated(spark):
    words = spark.createDataFrame([("abcdefgh",), ("abcdefgx",)], "w string")
    found = fuzzy.best_match(words, "w", ["abcdefgh", "abcdefgy"], 0.75, phonetic=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The one aggregate takes the best of each word.
    assert plan.count("Aggregate [") == 1 and "collect_set" not in plan
    assert {r.w: (r.match, r.method) for r in found.collect()} == {"abcdefgh": ("abcdefgh", "LEVENSHTEIN"), "abcdefgx": ("abcdefgh", "LEVENSHTEIN")}


def test_words_of_a_query_are_made_once(spark, sf_dir):
    from nothi.plans import queries_correct

    plan = queries_correct.word_correct(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_repeated_words(spark):
    rows = spark.createDataFrame([("abcdefgh", 1), ("abcdefgx", 2), ("abcdefgx", 3), ("zzzzzz", 4), (None, 5)], "w string, n int")
    given = correct.correct_words(rows, "w", [("abcdefgh", "right")], [])
    assert sorted((r.n, r.corrected, r.method) for r in given.collect()) == [(1, "right", "EXACT_DICTIONARY"), (2, "right", "FUZZY_MATCH"), (3, "right", "FUZZY_MATCH"), (4, "zzzzzz", "NO_MATCH"), (5, None, "NO_MATCH")]


def mutated(rng, word, n):
    for _ in range(n):
        at = rng.randrange(len(word))
        word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("xyz") + word[at:], word[:at] + rng.choice("xyz") + word[at + 1 :]])
    return word


@pytest.mark.parametrize("threshold", [0.75, 0.8])
def test_long_words_of_tables(spark, threshold):
    """Words of 10 to 30 letters from few syllables, with entries at up to seven edits."""
    rng = random.Random(7)
    parts = "an en on ti re ha he th er nd st al".split()
    entries = list(dict.fromkeys("".join(rng.choices(parts, k=rng.randint(5, 14))) for _ in range(150)))
    words = list(dict.fromkeys(mutated(rng, rng.choice(entries), rng.randint(1, 7)) for _ in range(250)))
    listed = spark.createDataFrame([(e,) for e in entries], "entry string")
    got = {r.w: (r.match, round(r.score, 9)) for r in fuzzy.best_match(spark.createDataFrame([(w,) for w in words], "w string"), "w", listed, threshold).collect()}
    entries.sort()
    for w in words:
        match, score, _ = every(w, "", entries, entries, threshold, False, 0)
        assert got[w] == (match, round(score, 9)), w


def test_words_with_an_entry_at_few_edits_ask_no_parts(spark, monkeypatch):
    """Parts are shared by many texts, so only words without a near entry ask by them, and of entries that are long enough for more edits."""
    rng, asked, rows = random.Random(8), fuzzy.asked, []
    monkeypatch.setattr(fuzzy, "asked", lambda *a, **k: rows.append(asked(*a, **k)) or rows[-1])
    entries = ["".join(rng.choices("abcdefgh", k=16)) for _ in range(40)]
    words = ["zz" + e[2:] for e in entries] + ["zz" + e[2:15] + "z" for e in entries]
    found = fuzzy.best_match(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(e,) for e in entries], "entry string"), 0.75)
    assert {r.w: r.match for r in found.collect()} == dict(zip(words, entries * 2))
    assert sum(r.count() for r in rows) == 0

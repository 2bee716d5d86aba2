"""Likeness of texts as column expressions: character n-grams, Jaccard, edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nothi.functions.bengali import SPACE, skeleton, text


def ngrams(c: Column | str, n: int = 2) -> Column:
    """Distinct character n-grams without white space, in lower case; none if the text has under n characters."""
    s = text(c)
    clean = F.lower(F.regexp_replace(s, SPACE + "+", ""))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(clean) - (n - 1)), lambda i: F.substring(clean, i, F.lit(n))))
    return F.when((F.length(s) < n) | (F.length(clean) < n), F.array().cast("array<string>")).otherwise(grams)


def jaccard(a: Column, b: Column) -> Column:
    """Shared parts of all; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / F.greatest(whole, F.lit(1)))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def phonetic_similarity(a: Column, b: Column) -> Column:
    return similarity(skeleton(a), skeleton(b))

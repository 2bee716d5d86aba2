"""Person names: likeness to a name, parts, structure, quality of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nothi.functions.bengali import SPACE, strip, text

BENGALI = "[\u0980-\u09ff]"


def words(c: Column | str) -> Column:
    return F.split(strip(text(c)), SPACE + "+")


def is_likely_name(c: Column | str) -> Column:
    """One to five words of 2 to 20 characters, some Bengali, at most a fifth of the characters not (spaces count)."""
    s = text(c)
    n, bengali, parts = F.length(s), F.regexp_count(s, F.lit(BENGALI)), words(c)
    sized = F.forall(parts, lambda w: (F.length(w) >= 2) & (F.length(w) <= 20))
    return (n > 0) & (F.size(parts) <= 5) & sized & (bengali > 0) & ((n - bengali) <= 0.2 * n)


def split_name(c: Column | str) -> Column:
    """first_name, surname (the last word; none for a single word) and full_name."""
    parts = words(c)
    one = F.size(parts) == 1
    first = F.when(one, F.element_at(parts, 1)).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), " "))
    return F.struct(first.alias("first_name"), F.when(one, "").otherwise(F.element_at(parts, -1)).alias("surname"), text(c).alias("full_name"))


def join_name(first: Column, surname: Column) -> Column:
    return F.concat_ws(" ", F.filter(F.array(first, surname), lambda x: F.coalesce(x, F.lit("")) != ""))


def name_structure(name: Column | str, father: Column | str, mother: Column | str) -> Column:
    """valid, errors, warnings: what a record lacks."""
    lacks = lambda c: strip(text(c)) == ""
    errors = F.array_compact(F.array(F.when(lacks(name), "Missing person name")))
    warnings = F.array_compact(F.array(F.when(lacks(father), "Missing father name"), F.when(lacks(mother), "Missing mother name")))
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"))


def _bengali_points(c: Column | str, most: int) -> Column:
    s = text(c)
    dense = F.length(F.regexp_replace(s, SPACE, ""))
    points = F.least(F.lit(most), F.coalesce(F.floor(F.try_divide(F.regexp_count(s, F.lit(BENGALI)) * most, dense) + 0.5), F.lit(0)))
    return F.when(F.length(s) > 2, points).otherwise(0).cast("int")


def quality(name: str = "name", father: str = "father", mother: str = "mother", number: str = "number", nid: str = "nid", district: str = "district", upazila: str = "upazila", village: str = "village", ward: str = "ward") -> Column:
    """score (0 to 100) and level of a record; only ASCII digits count as numbers."""
    has = lambda c, n: F.when(text(c) != "", n).otherwise(0)
    score = _bengali_points(name, 40) + _bengali_points(father, 15) + F.when(F.length(text(mother)) > 2, 10).otherwise(0)
    score = score + F.when(text(number).rlike(r"^[0-9]{5,}\z"), 15).otherwise(0) + F.when(text(nid).rlike(r"^[0-9]{10,17}\z"), 10).otherwise(0)
    score = score + has(district, 3) + has(upazila, 3) + has(village, 2) + has(ward, 2)
    level = F.when(score >= 80, "EXCELLENT").when(score >= 60, "GOOD").when(score >= 40, "FAIR").otherwise("POOR")
    return F.struct(F.least(F.lit(100), score).cast("int").alias("score"), level.alias("level"))


def edit_counts(corrections: Column) -> Column:
    """Number of corrections by kind, from an array of structs with a field ``kind``."""
    n = lambda k: F.size(F.filter(corrections, lambda x: x["kind"] == k))
    return F.struct(n("dict").alias("dict"), n("name").alias("name"), n("geo").alias("geo"), F.size(corrections).alias("total"))

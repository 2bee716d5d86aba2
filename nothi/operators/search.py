"""Search over records: predicates, modes, paging.

``phonetic`` mode matches a term if it is a part of the value, or its skeleton a part of the value's skeleton, or all its words of two
letters or more are. ``ilike`` mode matches as a database would: case-insensitive parts, equality for places. Search skeletons
are columns written at ingest (``with_keys``); a term's skeleton is taken once, in the driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nothi.functions import bengali
from nothi.functions.bengali import text
from nothi.functions.similarity import jaccard, ngrams

#: Columns with a search key; village and area are searched together.
KEYED = ("name", "father", "mother", "village", "area", "upazila", "district", "occupation")
#: What the register calls the genders.
GENDERS = {"male": "পুরুষ", "female": "মহিলা"}
FUZZY = 0.35
_CLASSES = str.maketrans(bengali.ALIKE, bengali.STANDS_FOR)


def key_of(term: str) -> str:
    """The search key of a term, in the driver; the same steps as ``bengali.search_key``."""
    s = re.sub(bengali.SIGNS, "", term.replace(bengali.TYPO, bengali.TYPO_RIGHT).translate(_CLASSES))
    return re.sub("[\\s\ufeff]+", " ", s).strip(" ").lower()


def with_keys(df: DataFrame, columns: tuple[str, ...] = KEYED) -> DataFrame:
    return df.withColumns({f"key_{c}": bengali.search_key(c) for c in columns if c in df.columns})


def with_index(df: DataFrame) -> DataFrame:
    """Keys, and the bigrams of the names."""
    out = with_keys(df)
    return out.withColumns({f"grams_{c}": ngrams(f"key_{c}", 2) for c in ("name", "father") if c in df.columns})


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(value: Column | str, key: Column | str, term: str) -> Column:
    """The phonetic predicate; cheap tests first. An empty value or term matches nothing, a missing value gives null.

    Plain ``contains`` of plain columns, so that a scan can take the filter.
    """
    value, key, asked = _col(value), _col(key), key_of(term)
    if not term:
        return F.lit(False)
    words = [w for w in asked.split(" ") if len(w) >= 2]
    hit = value.contains(term)
    if asked:
        hit = hit | key.contains(asked)
    if len(words) > 1:
        hit = hit | reduce(lambda a, b: a & b, [key.contains(w) for w in words])
    return (value != "") & hit


def multi_mode(value: Column | str, key: Column | str, grams: Column | str, term: str, mode: str = "all") -> Column:
    """matched, score and method of the first mode that hits: exact, partial, phonetic, all words, fuzzy."""
    value, key = text(value), text(key)
    grams = F.col(grams) if isinstance(grams, str) else grams
    asked = key_of(term)
    words = [w for w in asked.split(" ") if len(w) >= 2]
    like = jaccard(grams, ngrams(F.lit(asked), 2))
    result = lambda score, method: F.struct(F.lit(True).alias("matched"), score.cast("double").alias("score"), F.lit(method).alias("method"))
    none = F.struct(F.lit(False).alias("matched"), F.lit(0.0).alias("score"), F.lit("none").alias("method"))
    out = F.when((value == "") | F.lit(term == ""), none)
    if mode in ("exact", "all"):
        out = out.when(value == term, result(F.lit(1.0), "exact"))
    if mode in ("partial", "all"):
        out = out.when(value.contains(term), result(F.lit(0.95), "partial"))
    if mode in ("phonetic", "all") and asked:
        out = out.when(key.contains(asked), result(F.lit(0.85), "phonetic"))
        if len(words) > 1:
            out = out.when(reduce(lambda a, b: a & b, [key.contains(w) for w in words]), result(F.lit(0.80), "phonetic_multiword"))
    if mode in ("fuzzy", "all"):
        out = out.when(like >= FUZZY, result(like, "fuzzy_ngram"))
    return out.otherwise(none)


def _like(c: str, term: str) -> Column:
    return F.ilike(F.col(c), F.lit("%" + term.replace("\\", "\\\\") + "%"))


def predicate(mode: str = "phonetic", **fields: str | None) -> Column:
    """The conjunction over all given fields, as a filter; blank ones ask nothing, and a missing value is no match."""
    given = {k: v.strip() for k, v in fields.items() if v and v.strip()}
    gender = GENDERS.get(given.pop("gender", ""), None)
    out = F.lit(True)
    for field, term in given.items():
        if field == "nid":
            p = F.col("nid") == term
        elif mode == "ilike":
            if field in ("village", "area"):
                p = _like("village", term) | _like("area", term)
            elif field in ("upazila", "district", "occupation"):
                p = F.col(field) == term
            else:
                p = _like(field, term)
        elif field == "number":
            p = F.col("number").contains(term)
        elif field in ("village", "area"):
            p = matches("village", "key_village", term) | matches("area", "key_area", term)
        else:
            p = matches(field, f"key_{field}", term)
        out = out & p
    return out & (F.col("gender") == gender) if gender else out


def any_column_contains(columns: list[str], term: str) -> Column:
    return reduce(lambda a, b: a | b, [text(c).contains(term) for c in columns])


def _whole(value: object, default: int) -> int:
    """The integer that a parameter begins with; the default for none and for zero."""
    m = re.match(r"\s*([+-]?\d+)", str(value)) if value is not None else None
    return (int(m[1]) if m else 0) or default


def page_bounds(page: object = 1, limit: object = 100) -> tuple[int, int]:
    """(page, rows a page): a page from 1, rows from 1 to 200, 100 if not given or zero."""
    return max(1, _whole(page, 1)), min(200, max(1, _whole(limit, 100)))


def paged(df: DataFrame, order: list[Column | str], page: object = 1, limit: object = 100) -> DataFrame:
    """One page of rows in an order that has no ties."""
    number, size = page_bounds(page, limit)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search(df: DataFrame, order: list[Column | str], page: object = 1, limit: object = 100, mode: str = "phonetic", **fields: str | None) -> tuple[DataFrame, DataFrame]:
    """(a page of matching rows, a one-row table with their total)."""
    hits = df.filter(predicate(mode, **fields))
    return paged(hits, order, page, limit), hits.agg(F.count("*").alias("total"))


def newest(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n)


def retained(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    """The newest n rows and no more, also where ``by`` and ``tie`` repeat; a bounded top-n, so no task sorts the table."""
    return newest(df, n, by, tie)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")

"""Batch jobs over the register: ingest of pages, repair, ordered replacements, outside corrections, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nothi.functions import lookups
from nothi.functions.bengali import text
from nothi.functions.misc import row_diff
from nothi.functions.ordered import replaced
from nothi.operators import correct, extract, layout
from nothi.operators.search import with_keys

#: Replacements that are nested natively; longer tables would outgrow the code generator.
NATIVE = 16
TEXTS, NAMES = ("name", "father", "mother", "occupation", "address"), ("name", "father", "mother")


def records_from_items(items: DataFrame) -> DataFrame:
    """Positioned items to register entries with their cover's fields: columns, lines, cover, entries."""
    used = layout.usable_items(items)
    first = layout.lines(used.filter("page = 1"), ["doc", "page"])
    rest = layout.lines(layout.columns(used.filter("page >= 3")), ["doc", "page", "column"])
    cover = extract.cover_meta(first.select("doc", "line", "text"), lookups.UPAZILAS)
    return extract.with_cover(extract.records(rest), cover)


def corrected(df: DataFrame, key: str = "id", threshold: float = correct.NAME_INGEST, names_as_read: bool = False) -> DataFrame:
    """Texts by the table of misreadings, names by the most alike name, places by the districts; adds n_dict, n_name, n_geo. ``names_as_read``: names are looked at as they stood before the misreadings.

    ``key`` is unique. Names are joined back once, as one table over all name columns.
    """
    texts = [c for c in TEXTS if c in df.columns]
    fixed = df.withColumns({f"_t_{c}": correct.correct_text(c) for c in texts})
    out = fixed.withColumns({c: F.when(text(c) != "", F.col(f"_t_{c}.corrected")).otherwise(F.col(c)) for c in texts})
    out = out.withColumn("n_dict", reduce(lambda a, b: a + b, [F.col(f"_t_{c}.n") for c in texts], F.lit(0))).drop(*[f"_t_{c}" for c in texts])
    names = [c for c in NAMES if c in df.columns]
    long = (df if names_as_read else out).select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in names])).alias("e")).select(F.concat_ws("\x01", F.col(key).cast("string"), "e.c").alias("_k"), F.col("e.v").alias("v")).filter(F.length("v") > 1)
    done = correct.correct_names(long, "v", "_k", threshold=threshold).select(F.split("_k", "\x01").alias("_s"), "corrected", "n").select(F.col("_s")[0].alias("_id"), F.col("_s")[1].alias("_c"), "corrected", "n")
    wide = done.groupBy("_id").agg(*[F.max(F.when(F.col("_c") == c, F.when(F.col("n") > 0, F.col("corrected")))).alias(f"_n_{c}") for c in names], F.sum("n").cast("int").alias("n_name"))
    out = out.withColumn("_id", F.col(key).cast("string")).join(wide, "_id", "left")
    out = out.withColumns({c: F.coalesce(f"_n_{c}", F.col(c)) for c in names}).withColumn("n_name", F.coalesce("n_name", F.lit(0))).drop("_id", *[f"_n_{c}" for c in names])
    if {"district", "upazila"} <= set(out.columns):
        places = correct.validate_addresses(out)
        changed = lambda a, b: (text(b) != "") & (text(a) != text(b))
        n = changed("district", "corrected_district").cast("int") + changed("upazila", "corrected_upazila").cast("int")
        out = places.withColumn("n_geo", n).withColumn("district", F.col("corrected_district")).withColumn("upazila", F.col("corrected_upazila")).drop("valid", "corrected_district", "corrected_upazila", "errors", "warnings")
    else:
        out = out.withColumn("n_geo", F.lit(0))
    return out


def repair(df: DataFrame, key: str = "id", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the repaired table with fresh search keys, a summary). A dry run is one that isn't written. With ``limit`` the first rows by key are repaired, all get keys."""
    part = df.orderBy(key).limit(limit) if limit else df
    done = corrected(part, key)
    whole = done if not limit else done.unionByName(df.join(part.select(key), key, "left_anti"), allowMissingColumns=True)
    return with_keys(whole.drop("n_dict", "n_name", "n_geo")), summary(done)


def summary(done: DataFrame) -> DataFrame:
    """processed, modified, percent (null when none), and corrections by kind."""
    total = F.col("n_dict") + F.col("n_name") + F.col("n_geo")
    out = done.agg(F.count("*").alias("processed"), F.count_if(total > 0).alias("modified"), *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).cast("long").alias(k) for k in ("dict", "name", "geo")])
    return out.withColumn("percent", F.try_divide(F.col("modified") * 100.0, F.col("processed").cast("double"))).withColumn("total", F.col("dict") + F.col("name") + F.col("geo"))


def replace_values(df: DataFrame, columns: list[str], table: dict[str, str]) -> DataFrame:
    """Whole values by a table."""
    m = correct.as_map(table)
    return df.withColumns({c: F.coalesce(F.try_element_at(m, F.col(c)), F.col(c)) for c in columns})


def replace_parts(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Ordered replacements of parts, later ones seeing what earlier ones made; adds ``changed``. Short tables stay native, longer ones go through an automaton."""

    def all_of(c):
        if len(pairs) > NATIVE:
            return F.when(F.col(c).isNotNull(), replaced(c, pairs)["text"])
        out = F.col(c)
        for bad, good in pairs:
            out = F.replace(out, F.lit(bad), F.lit(good))
        return out

    new = {c: all_of(c) for c in columns}
    done = df.withColumns({f"_new_{c}": v for c, v in new.items()})
    changed = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_new_{c}") != F.col(c), F.lit(False)) for c in columns])
    return done.withColumn("changed", changed).withColumns({c: F.col(f"_new_{c}") for c in columns}).drop(*[f"_new_{c}" for c in columns])


def occurrences(df: DataFrame, columns: list[str], part: str) -> DataFrame:
    """How often a text occurs in the columns, over all rows."""
    n = reduce(lambda a, b: a + b, [(F.length(text(c)) - F.length(F.replace(text(c), F.lit(part), F.lit("")))) / len(part) for c in columns])
    return df.agg(F.coalesce(F.sum(n), F.lit(0.0)).cast("long").alias("n"))


def outside_corrections(df: DataFrame, call: Callable[[list[dict]], list[dict]], fields: list[str], batch: int = 50) -> DataFrame:
    """Rows through an outside corrector in batches; where it fails, or answers for another number of rows, the rows stay as they are."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch].copy()
                try:
                    answer = call(part.to_dict("records"))
                    if len(answer) != len(part):
                        raise ValueError("an answer for each row is needed")
                    for f in fields:
                        part[f] = [a.get(f) or old for a, old in zip(answer, part[f])]
                except Exception:  # noqa: BLE001
                    part = pdf.iloc[at : at + batch]
                yield part[columns]

    return df.mapInPandas(run, df.schema)


def differences(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, was, now for every filled field that differs."""
    a, b = old.select(key, F.struct(*fields).alias("old")), new.select(key, F.struct(*fields).alias("new"))
    return a.join(b, key).select(key, F.explode(row_diff(fields)).alias("d")).select(key, "d.*")

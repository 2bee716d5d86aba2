"""Correction against lookup tables: exact first, then the most alike.

Lookups are tables: lists of checked size are broadcast, and nothing of them stands in the plan. Fuzzy matching asks an index
(``fuzzy``) with distinct words only and joins the results back, so its cost follows the vocabulary and not the rows. Of equally alike entries
the first in the table wins; a match must exceed the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nothi.functions import lookups, names
from nothi.functions.bengali import SPACE, skeleton, strip, text
from nothi.functions.ordered import replaced
from nothi.functions.similarity import similarity
from nothi.operators.fuzzy import best_match, looked_up, matches

WORD, NAME, NAME_INGEST, PLACE = 0.75, 0.70, 0.80, 0.70


def as_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.expr("cast(map() as map<string,string>)")


def correct_words(df: DataFrame, column: str, words: list | None = None, misread: list | None = None, threshold: float = WORD, exact: bool = True) -> DataFrame:
    """Adds ``corrected``, ``method`` and ``confidence`` of a single word per row."""
    words, misread = dict(lookups.WORDS if words is None else words), dict(lookups.MISREAD if misread is None else misread)
    out = looked_up(looked_up(df, column, misread if exact else {}, "_m"), column, words if exact else {}, "_d")
    open_ = out.filter(F.col("_m").isNull() & F.col("_d").isNull())
    fuzzy = matches(open_, column, list(words), threshold, phonetic=True)
    fuzzy = looked_up(fuzzy, "match", words, "_f").select(column, "_f", F.col("score").alias("_s"))
    out = out.join(fuzzy, column, "left")
    method = F.when(F.col("_m").isNotNull(), "EXACT_MISSPELLING").when(F.col("_d").isNotNull(), "EXACT_DICTIONARY").when(F.col("_f").isNotNull(), "FUZZY_MATCH").otherwise("NO_MATCH")
    confidence = F.when(F.col("_m").isNotNull() | F.col("_d").isNotNull(), 1.0).otherwise(F.coalesce("_s", F.lit(0.0)))
    return out.select(*df.columns, F.coalesce("_m", "_d", "_f", F.col(column)).alias("corrected"), method.alias("method"), confidence.alias("confidence"))


def correct_text(c: Column | str, misread: list | None = None) -> Column:
    """corrected and n: misread words replaced in table order, later entries seeing earlier results; n counts the entries that fired."""
    done = replaced(c, lookups.MISREAD if misread is None else misread, whole_words=True)
    return F.struct(done["text"].alias("corrected"), done["n"].alias("n"))


def correct_names(df: DataFrame, column: str, key: str, table: list | None = None, threshold: float = NAME) -> DataFrame:
    """key, corrected, method, confidence, n: every word of a likely name, exact spellings first, then the most alike name.

    ``key`` is unique. Words are matched as a set of distinct words.
    """
    table = lookups.NAMES if table is None else table
    rows = df.select(key, text(column).alias("_v"), names.is_likely_name(column).alias("_is"))
    parts = rows.filter("_is").select(key, F.posexplode(F.split(strip(F.col("_v")), SPACE + "+")).alias("_i", "_w"))
    listed = looked_up(parts, "_w", lookups.name_spellings(table), "_e")
    fuzzy = best_match(listed.filter("_e is null").select("_w").distinct(), "_w", lookups.canonical_names(table), threshold, phonetic=True, margin=0.05).filter("match is not null").select("_w", F.col("match").alias("_f"), F.col("score").alias("_s"))
    done = listed.join(fuzzy, "_w", "left").withColumn("_to", F.coalesce("_e", "_f", "_w")).withColumn("_c", F.when(F.col("_e").isNotNull(), 1.0).otherwise(F.col("_s")))
    whole = done.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_to"))).alias("_p"), F.avg("_c").alias("_a"), F.count_if(F.col("_to") != F.col("_w")).alias("n"))
    out = rows.join(whole, key, "left")
    return out.select(
        key,
        F.when(F.col("_is"), F.array_join(F.transform("_p", lambda x: x["_to"]), " ")).otherwise(F.col("_v")).alias("corrected"),
        F.when(~F.col("_is"), "NOT_A_NAME").when(F.col("n") > 0, "WORD_BY_WORD").otherwise("NO_MATCH").alias("method"),
        F.coalesce("_a", F.lit(0.0)).alias("confidence"),
        F.coalesce("n", F.lit(0)).cast("int").alias("n"),
    )


def correct_person_names(df: DataFrame, key: str, columns: list[str], table: list | None = None, threshold: float = NAME) -> DataFrame:
    """key, field, original, corrected of the name fields that change; all fields go through one vocabulary."""
    fields = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in columns])
    long = df.select(key, F.explode(fields).alias("e")).select(F.struct(F.col(key).alias("id"), F.col("e.f").alias("f")).alias("_k"), F.col("e.v").alias("v")).filter(text("v") != "")
    done = correct_names(long, "v", "_k", table, threshold).filter("n > 0")
    return done.join(long, "_k").select(F.col("_k.id").alias(key), F.col("_k.f").alias("field"), F.col("v").alias("original"), "corrected")


def validate_districts(df: DataFrame, column: str) -> DataFrame:
    """Adds ``canonical`` (null: not found), ``district_method``, ``district_confidence``, ``division``."""
    out = looked_up(df.withColumn("_t", strip(text(column))), "_t", lookups.district_spellings(), "_e")
    open_ = out.filter(F.col("_e").isNull() & (F.col("_t") != "")).select("_t").distinct()
    fuzzy = best_match(open_, "_t", [d for d, _ in lookups.DISTRICTS], PLACE).filter("match is not null").select("_t", F.col("match").alias("_f"), F.col("score").alias("_s"))
    out = looked_up(out.join(fuzzy, "_t", "left").withColumn("canonical", F.coalesce("_e", "_f")), "canonical", dict(lookups.DISTRICTS), "_division")
    return out.select(
        *df.columns,
        "canonical",
        F.when(F.col("_e").isNotNull(), "EXACT_MATCH").when(F.col("_f").isNotNull(), "FUZZY_MATCH").otherwise("NOT_FOUND").alias("district_method"),
        F.when(F.col("_e").isNotNull(), 1.0).otherwise(F.coalesce("_s", F.lit(0.0))).alias("district_confidence"),
        F.col("_division").alias("division"),
    )


def validate_upazilas(df: DataFrame, column: str) -> DataFrame:
    """For rows with ``canonical``: adds ``upazila_canonical`` and ``upazila_method``; districts without data accept any name."""
    out = df.withColumn("_u", text(column))
    known = df.sparkSession.createDataFrame([(d, i, u) for d, us in lookups.UPAZILAS.items() for i, u in enumerate(us)], "canonical string, _o int, _n string")
    asked = out.filter(F.col("canonical").isNotNull() & (F.col("_u") != "")).select("canonical", "_u").distinct()
    like = similarity(F.col("_u"), F.col("_n"))
    pairs = asked.join(F.broadcast(known), "canonical").withColumn("_s", F.when(F.col("_u") == F.col("_n"), 2.0).otherwise(like)).filter(F.col("_s") > PLACE)
    best = pairs.groupBy("canonical", "_u").agg(F.max_by(F.struct("_n", "_s"), F.struct(F.col("_s"), (-F.col("_o")).alias("o"))).alias("_b"))
    data = F.array(*[F.lit(d) for d in lookups.UPAZILAS])
    out = out.join(best, ["canonical", "_u"], "left")
    method = (
        F.when((F.col("_u") == "") | F.col("canonical").isNull(), "INVALID").when(~F.array_contains(data, F.col("canonical")), "NO_DATA").when(F.col("_b._s") > 1.5, "EXACT_MATCH").when(F.col("_b._n").isNotNull(), "FUZZY_MATCH").otherwise("NOT_FOUND")
    )
    return out.select(*df.columns, F.coalesce("_b._n", "_u").alias("upazila_canonical"), method.alias("upazila_method"))


def validate_addresses(df: DataFrame, district: str = "district", upazila: str = "upazila") -> DataFrame:
    """Adds valid, corrected_district, corrected_upazila, errors, warnings. An invalid district leaves the upazila alone."""
    out = validate_upazilas(validate_districts(df, district), upazila)
    has_d, has_u, found = text(district) != "", text(upazila) != "", F.col("canonical").isNotNull()
    valid = ~has_d | found
    errors = F.array_compact(F.array(F.when(has_d & ~found, F.concat(F.lit("Invalid district: "), F.col(district)))))
    warnings = F.array_compact(
        F.array(
            F.when(~has_d, "District not provided"),
            F.when(has_d & (F.col("district_method") == "FUZZY_MATCH"), F.concat(F.lit("District corrected: "), F.col(district), F.lit(" → "), F.col("canonical"))),
            F.when(valid & has_u & F.col("upazila_method").isin("NOT_FOUND", "INVALID"), F.concat(F.lit("Upazila not found: "), F.col(upazila))),
            F.when(valid & has_u & (F.col("upazila_method") == "FUZZY_MATCH"), F.concat(F.lit("Upazila corrected: "), F.col(upazila), F.lit(" → "), F.col("upazila_canonical"))),
        )
    )
    put = F.when(valid & has_u & F.col("upazila_method").isin("EXACT_MATCH", "FUZZY_MATCH", "NO_DATA"), F.col("upazila_canonical")).otherwise(F.col(upazila))
    return out.select(*df.columns, valid.alias("valid"), F.coalesce(F.col("canonical"), F.col(district)).alias("corrected_district"), put.alias("corrected_upazila"), errors.alias("errors"), warnings.alias("warnings"))


def contained_entry(value: Column | str, entries: list[str]) -> Column:
    """The first entry that the value contains; else the value."""
    hits = F.filter(F.array(*[F.lit(e) for e in entries]).cast("array<string>"), lambda e: F.contains(text(value), e))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), text(value))


def merge_corrected(rows: DataFrame, fixed: DataFrame, fields: list[str], ids: tuple[str, str] = ("id", "serial"), order: str = "position") -> DataFrame:
    """Corrected rows merged back by either id, the first by position: two equi joins instead of a disjunction."""
    sides = []
    for i, k in enumerate(ids):
        once = fixed.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(F.struct(order, *fields)).alias(f"_{i}"))
        rows = rows.join(once, k, "left")
        sides.append(F.col(f"_{i}"))
    first = F.when(sides[0].isNull(), sides[1]).when(sides[1].isNull(), sides[0]).when(sides[1][order] < sides[0][order], sides[1]).otherwise(sides[0])
    kept = [c for c in rows.columns if c not in ("_0", "_1")]
    return rows.select(*[F.coalesce(F.nullif(first[c], F.lit("")), F.col(c)).alias(c) if c in fields else F.col(c) for c in kept])

"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.functions import bengali

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quote(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    if isinstance(x, int):
        return f"CAST({x} AS BIGINT)"
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]" + ("::VARCHAR[]" if not x else "")
    return quote(x)


def values(rows: list[tuple], names: list[str]) -> str:
    """Rows as a SQL query."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"


def cases(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """Every customer as ``id`` with one of the given rows, in turn by its key."""
    given = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {schema}")
    turn = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % len(rows)).cast("int").alias("_k"))
    return turn.join(F.broadcast(given), "_k").drop("_k")


def cases_sql(rows: list[tuple], names: list[str]) -> str:
    """The same in SQL, with what is expected of each row."""
    return f"SELECT c.c_custkey AS id, {', '.join(names)} FROM customer c JOIN ({values([(k, *r) for k, r in enumerate(rows)], ['_k', *names])}) v ON c.c_custkey % {len(rows)} = v._k"


def pick(words: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(key, F.lit(len(words))) + 1).cast("int"))


def pick_sql(words: list[str], key: str) -> str:
    return f"([{', '.join(map(quote, words))}])[CAST(({key}) % {len(words)} AS INTEGER) + 1]"


#: Generic words from which people are made for tests.
FIRST = "করিম রহিম কামাল ফাতেমা আমেনা সালমা জামাল হাসান নাসিমা".split()
LAST = "হোসেন আহমেদ খাতুন আলী শেখ মণ্ডল বেগম".split()
VILLAGES = "পূর্ব পাড়া,পশ্চিম পাড়া,দক্ষিণ গ্রাম,উত্তর গ্রাম,নদীর ঘাট,পুরান বাজার".split(",")
UPAZILAS, PLACES = "দৌলতপুর তেরখাদা গোলাপগঞ্জ চৌগাছা".split(), "খুলনা সিলেট যশোর ঢাকা রংপুর".split()
JOBS = "কৃষক শিক্ষক ব্যবসা গৃহিণী".split()
GENDERS = ["পুরুষ", "মহিলা"]
_MADE = {"name": (FIRST, "k"), "last": (LAST, "k"), "father": (FIRST, "k * 3"), "mother": (FIRST, "k + 4"), "village": (VILLAGES, "k"), "area": (VILLAGES, "k + 2"), "upazila": (UPAZILAS, "k"), "district": (PLACES, "k"), "occupation": (JOBS, "k"), "gender": (GENDERS, "k")}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up people, one per customer; some fields of some are empty or null."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    made = {n: pick(w, F.expr(e)) for n, (w, e) in _MADE.items()}
    out = c.withColumns(made).withColumn("name", F.concat_ws(" ", "name", "last")).drop("last")
    return out.select(
        F.concat(F.lit("p"), F.col("k").cast("string")).alias("id"),
        "k",
        "name",
        F.when(F.col("k") % 13 == 0, F.lit(None)).otherwise(F.col("father")).alias("father"),
        F.when(F.col("k") % 17 == 0, F.lit("")).otherwise(F.col("mother")).alias("mother"),
        F.when(F.col("k") % 11 == 0, F.lit("")).otherwise(F.col("village")).alias("village"),
        F.when(F.col("k") % 19 == 0, F.lit(None)).otherwise(F.col("area")).alias("area"),
        "upazila",
        "district",
        "occupation",
        "gender",
        F.lpad((F.col("k") * 37).cast("string"), 8, "0").alias("number"),
        F.lpad((F.col("k") * 7919).cast("string"), 10, "1").alias("nid"),
    )


def _people_sql() -> str:
    p = {n: pick_sql(w, e) for n, (w, e) in _MADE.items()}
    return f"""people AS (SELECT 'p' || k AS id, k, {p['name']} || ' ' || {p['last']} AS name, CASE WHEN k % 13 <> 0 THEN {p['father']} END AS father,
      CASE WHEN k % 17 = 0 THEN '' ELSE {p['mother']} END AS mother, CASE WHEN k % 11 = 0 THEN '' ELSE {p['village']} END AS village,
      CASE WHEN k % 19 <> 0 THEN {p['area']} END AS area, {p['upazila']} AS upazila, {p['district']} AS district, {p['occupation']} AS occupation, {p['gender']} AS gender,
      lpad(CAST(k * 37 AS VARCHAR), 8, '0') AS number, lpad(CAST(k * 7919 AS VARCHAR), 10, '1') AS nid FROM (SELECT c_custkey AS k FROM customer))"""


PEOPLE = _people_sql()


def key_sql(x: str) -> str:
    """The search key of a column in SQL."""
    s = f"translate(replace(coalesce({x}, ''), {quote(bengali.TYPO)}, {quote(bengali.TYPO_RIGHT)}), {quote(bengali.ALIKE)}, {quote(bengali.STANDS_FOR)})"
    return f"lower(trim(regexp_replace(regexp_replace({s}, '[\\x{{09BC}}\\x{{09BE}}-\\x{{09CD}}\\x{{09D7}}]', '', 'g'), '\\s+', ' ', 'g')))"


def match_sql(value: str, term: str) -> str:
    """The phonetic predicate in SQL."""
    from nothi.operators.search import key_of

    asked = key_of(term)
    words = [w for w in asked.split(" ") if len(w) >= 2]
    parts = [f"contains({value}, {quote(term)})", f"contains({key_sql(value)}, {quote(asked)})"]
    if len(words) > 1:
        parts.append("(" + " AND ".join(f"contains({key_sql(value)}, {quote(w)})" for w in words) + ")")
    return f"(coalesce({value}, '') <> '' AND ({' OR '.join(parts)}))"


def grams_sql(x: str, n: int = 2) -> str:
    clean = f"lower(regexp_replace(coalesce({x}, ''), '\\s+', '', 'g'))"
    return f"CASE WHEN length(coalesce({x}, '')) < {n} OR length({clean}) < {n} THEN []::VARCHAR[] ELSE list_distinct([substring({clean}, CAST(i AS BIGINT), {n}) for i in range(1, length({clean}) - {n - 2})]) END"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) END"

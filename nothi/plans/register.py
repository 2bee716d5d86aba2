"""Register pages made from the tables: every customer is an entry, every supplier a cover; with the same lines in SQL.

Entries differ by their keys: markers with and without a space, wrapped names, lines that are missing or hold two labels, noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.functions.bengali import DIGITS, DIGITS_BN, to_bengali_digits
from nothi.plans.registry import PEOPLE, PLACES, UPAZILAS, VILLAGES, people, pick, pick_sql, quote, table

DOC, PAGE = 300, 15
_DATE = "concat(cast({k} % 28 + 1 as string), '/', cast({k} % 12 + 1 as string), '/', cast(1950 + {k} % 50 as string))"


def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, page, column, line, text, x, y, width, height."""
    p, k = people(spark, sf_dir), F.col("k")
    bn = lambda e: to_bengali_digits(F.expr(e))
    word = lambda i: F.split("name", " ")[i]
    texts = [
        F.concat(bn(f"lpad(cast(k % {DOC} + 1 as string), 3, '0')"), F.when(k % 11 == 5, ".").otherwise(". "), F.when(k % 7 == 3, "").otherwise("নাম: "), F.when(k % 5 == 2, word(0)).otherwise(F.col("name"))),
        F.when(k % 5 == 2, word(1)),
        F.when(k % 9 != 4, F.concat(F.lit("ভোটার নং: "), to_bengali_digits("nid"))),
        F.concat(F.lit("পিতা: "), "father"),
        F.when(F.coalesce("mother", F.lit("")) != "", F.concat(F.lit("মাতা: "), "mother", F.when(k % 8 == 1, F.concat(F.lit(" পেশা: "), "occupation")).otherwise(""))),
        F.when(k % 8 != 1, F.concat(F.lit("পেশা: "), "occupation", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(", জন্ম তারিখ: "), bn(_DATE.format(k="k")))))),
        F.when(k % 6 == 1, F.concat(F.lit("ঠিকানা: "), "village")),
        F.lit("কিছু লেখা 12"),
    ]
    rows = p.select("k", F.posexplode(F.array(*texts)).alias("o", "text")).filter("text is not null")
    line = ((k % PAGE) * 10 + F.col("o")).cast("int")
    return rows.select(F.expr(f"k div {DOC}").alias("doc"), F.expr(f"cast(3 + (k % {DOC}) div {PAGE} as int)").alias("page"), F.lit(1).alias("column"), line.alias("line"), "text", F.lit(10.0).alias("x"), (2000.0 - 10 * line).alias("y"), F.lit(100.0).alias("width"), F.lit(8.0).alias("height"))


def cover_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, line, text."""
    s, c = F.col("s"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    bn = lambda e: to_bengali_digits(F.expr(e))
    district, village = pick(PLACES, s), pick(VILLAGES, s)
    texts = [
        F.concat(F.lit("চূড়ান্ত ভোটার তালিকা"), F.when(s % 3 == 0, " (মহিলা)").when(s % 3 == 1, " (পুরুষ)").otherwise("")),
        F.when(s % 4 == 1, "জেলা:").otherwise(F.concat(F.lit("জেলা: "), district, F.when(s % 2 == 0, "\tবিভাগ").otherwise(""))),
        F.when(s % 4 == 1, district),
        F.concat(F.lit("উপজেলা/থানা: "), pick(UPAZILAS, s), F.lit(" সদর")),
        F.concat(F.when(s % 5 == 2, "ডাকঘর: ").otherwise("ভোটার এলাকার নাম: "), village),
        F.concat(F.lit("ভোটার এলাকার নম্বর: "), bn("lpad(cast(s as string), 4, '0')")),
        F.concat(F.lit("সর্বমোট ভোটার সংখ্যা: "), bn("concat(cast((s * 7 + 1000) div 1000 as string), ',', lpad(cast((s * 7 + 1000) % 1000 as string), 3, '0'))")),
        F.when(s % 3 == 1, F.concat(F.lit("মোট পুরুষ ভোটার: "), bn("cast(s as string)"))).when(s % 3 == 0, F.concat(F.lit("মোট মহিলা ভোটার: "), bn("cast(s as string)"))),
        F.concat(F.lit("প্রকাশের তারিখ: "), bn(_DATE.format(k="s"))),
        F.when(s % 6 != 0, F.concat(F.lit("পোস্টকোড: "), bn("cast(9000 + s % 999 as string)"))),
    ]
    return c.select(s.alias("doc"), F.posexplode(F.array(*texts)).alias("line", "text")).filter("text is not null")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positioned items of both: covers on the first page, a page that is skipped, entries from the third on."""
    box = lambda y: [F.lit(10.0).alias("x"), y.alias("y"), F.lit(100.0).alias("width"), F.lit(8.0).alias("height")]
    cover = cover_lines(spark, sf_dir).select("doc", F.lit(1).alias("page"), F.col("line").alias("seq"), F.col("text").alias("str"), *box(700.0 - 20 * F.col("line")))
    skipped = cover.filter("seq = 0").withColumn("page", F.lit(2)).withColumn("str", F.lit("১০১. skipped"))
    return cover.unionByName(skipped).unionByName(entry_lines(spark, sf_dir).select("doc", "page", F.col("line").alias("seq"), F.col("text").alias("str"), "x", "y", "width", "height"))


def _bn(e: str) -> str:
    return f"translate(CAST({e} AS VARCHAR), '{DIGITS}', '{DIGITS_BN}')"


_DATE_SQL = "CAST({k} % 28 + 1 AS VARCHAR) || '/' || CAST({k} % 12 + 1 AS VARCHAR) || '/' || CAST(1950 + {k} % 50 AS VARCHAR)"
_TEXTS = [
    f"{_bn(f'lpad(CAST(k % {DOC} + 1 AS VARCHAR), 3, chr(48))')} || CASE WHEN k % 11 = 5 THEN '.' ELSE '. ' END || CASE WHEN k % 7 = 3 THEN '' ELSE 'নাম: ' END || CASE WHEN k % 5 = 2 THEN split_part(name, ' ', 1) ELSE name END",
    "CASE WHEN k % 5 = 2 THEN split_part(name, ' ', 2) END",
    f"CASE WHEN k % 9 <> 4 THEN 'ভোটার নং: ' || {_bn('nid')} END",
    "'পিতা: ' || father",
    "CASE WHEN coalesce(mother, '') <> '' THEN 'মাতা: ' || mother || CASE WHEN k % 8 = 1 THEN ' পেশা: ' || occupation ELSE '' END END",
    f"CASE WHEN k % 8 <> 1 THEN 'পেশা: ' || occupation || CASE WHEN k % 4 = 0 THEN '' ELSE ', জন্ম তারিখ: ' || {_bn(_DATE_SQL.format(k='k'))} END END",
    "CASE WHEN k % 6 = 1 THEN 'ঠিকানা: ' || village END",
    "'কিছু লেখা 12'",
]
#: The lines and the entries that they belong to: a marker without a space is a line of the entry before. Misread labels before a name go, even where a name begins like one.
ENTRIES = f"""{PEOPLE}, l AS ({' UNION ALL '.join(f'SELECT k, {o} AS o, {t} AS t FROM people' for o, t in enumerate(_TEXTS))}),
  n AS (SELECT k // {DOC} AS doc, k, o, t, row_number() OVER (PARTITION BY k // {DOC} ORDER BY k, o) AS pos FROM l WHERE t IS NOT NULL),
  s AS (SELECT *, max(CASE WHEN o = 0 AND (k % 11 <> 5 OR pos = 1) THEN pos END) OVER (PARTITION BY doc ORDER BY pos) AS start FROM n),
  e AS (SELECT * FROM s WHERE pos <= start + 12),
  b AS (SELECT doc, start, min(CASE WHEN t LIKE 'ভোটার নং: %' OR t LIKE 'পিতা: %' THEN pos END) AS known FROM e GROUP BY doc, start),
  entries AS (SELECT e.doc, split_part(min(CASE WHEN pos = start THEN t END), '.', 1) AS serial, CAST(min(CASE WHEN pos = start THEN k END) % {DOC} + 1 AS BIGINT) AS serial_num,
    regexp_replace(regexp_replace(min(CASE WHEN pos = start THEN t END), '^[^.]*\\. ?(নাম: )?', ''), '^(নাম|নাঃ|নাস|নামের|নামঃ)[ :।._-]*', '') || coalesce(string_agg(CASE WHEN o = 1 AND pos > start AND pos < coalesce(known, 1000000000) THEN ' ' || t END, '' ORDER BY pos), '') AS name,
    coalesce(arg_max(substr(t, length('ভোটার নং: ') + 1), pos) FILTER (WHERE t LIKE 'ভোটার নং: %'), '') AS number,
    coalesce(arg_max(substr(t, length('পিতা: ') + 1), pos) FILTER (WHERE t LIKE 'পিতা: %'), '') AS father,
    coalesce(arg_max(split_part(substr(t, length('মাতা: ') + 1), ' পেশা: ', 1), pos) FILTER (WHERE t LIKE 'মাতা: %'), '') AS mother,
    coalesce(arg_max(CASE WHEN contains(t, ', জন্ম') THEN split_part(substr(t, length('পেশা: ') + 1), ', জন্ম', 1) || ',' ELSE substr(t, length('পেশা: ') + 1) END, pos) FILTER (WHERE t LIKE 'পেশা: %'), '') AS occupation,
    coalesce(arg_max(split_part(t, 'তারিখ: ', 2), pos) FILTER (WHERE contains(t, 'জন্ম তারিখ: ')), '') AS dob,
    coalesce(arg_max(substr(t, length('ঠিকানা: ') + 1), pos) FILTER (WHERE t LIKE 'ঠিকানা: _%'), '') AS address
    FROM e JOIN b USING (doc, start) GROUP BY e.doc, start)"""
_D, _U, _V = pick_sql(PLACES, "s"), pick_sql(UPAZILAS, "s"), pick_sql(VILLAGES, "s")


def covers_sql(known: dict[str, list[str]]) -> str:
    """The fields of the covers; of an upazila that its district has, the bare name."""
    bare = " OR ".join(f"{_D} = {quote(d)} AND {_U} IN ({', '.join(map(quote, us))})" for d, us in known.items())
    return f"""covers AS (SELECT s AS doc, {_D} AS district, {_U} || CASE WHEN {bare} THEN '' ELSE ' সদর' END AS upazila, {_V} AS area, {_bn("lpad(CAST(s AS VARCHAR), 4, '0')")} AS area_no,
  CAST(s * 7 + 1000 AS BIGINT) AS total, CAST(CASE WHEN s % 3 = 1 THEN s ELSE 0 END AS BIGINT) AS total_male, CAST(CASE WHEN s % 3 = 0 THEN s ELSE 0 END AS BIGINT) AS total_female,
  CASE WHEN s % 3 = 0 THEN {quote('মহিলা')} ELSE {quote('পুরুষ')} END AS gender, {_bn(_DATE_SQL.format(k='s'))} AS published, CASE WHEN s % 6 <> 0 THEN {_bn('9000 + s % 999')} ELSE '' END AS post_code FROM (SELECT s_suppkey AS s FROM supplier))"""

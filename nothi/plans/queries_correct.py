"""Correction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nothi.functions import lookups
from nothi.operators import correct
from nothi.plans import jobs, repair
from nothi.plans.dashboard import lookup_stats
from nothi.plans.registry import PEOPLE, PLACES, cases, cases_sql, people, query, quote, table, values
from nothi.sources import scratch

_ENTRIES = ["small", "large", "steel", "copper", "green", "red", "blue"]
_LIST = ", ".join(f"({i}, {quote(e)})" for i, e in enumerate(_ENTRIES))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name) || ' smal stel copr gren', ' ')) AS word FROM part), l(ord, entry) AS (VALUES {_LIST}),
  s AS (SELECT word, ord, entry, 1 - CAST(levenshtein(word, entry) AS DOUBLE) / greatest(length(word), length(entry)) AS sim FROM w, l),
  b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, ord) AS n FROM s WHERE sim > CAST(0.6 AS DOUBLE))
  SELECT w.word, b.entry AS match, round(coalesce(b.sim, 0), 9) AS score FROM w LEFT JOIN b ON w.word = b.word AND b.n = 1""")
def levenshtein_best_match(spark, sf_dir):
    """Distinct words against a lookup; the first of equals wins."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.concat(F.lower("p_name"), F.lit(" smal stel copr gren")), " ")).alias("word")).distinct()
    found = correct.best_match(words, "word", _ENTRIES, 0.6)
    return found.select("word", "match", F.round(F.when(F.col("match").isNotNull(), F.col("score")).otherwise(0.0), 9).alias("score"))


def _vocabulary_sql(table: str) -> str:
    return f"SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{3,}}'))) AS w FROM {table}"


def _vocabulary(spark, sf_dir, name):
    return table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()


@query(f"""WITH e AS ({_vocabulary_sql("conversations")}), w AS ({_vocabulary_sql("documents")}),
  p AS (SELECT w.w AS word, e.w AS entry, 1.0::DOUBLE - levenshtein(w.w, e.w)::DOUBLE / greatest(length(w.w), length(e.w)) AS sim FROM w JOIN e ON length(e.w) > length(w.w) * 0.75 AND length(w.w) > length(e.w) * 0.75),
  b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, entry) AS n FROM p WHERE sim > 0.75::DOUBLE)
  SELECT w.w AS word, b.entry AS match, round(b.sim, 9) AS score FROM w LEFT JOIN b ON w.w = b.word AND b.n = 1""")
def fuzzy_lookup(spark, sf_dir):
    """Every word of the documents against the vocabulary of the conversations, by the index."""
    found = correct.best_match(_vocabulary(spark, sf_dir, "documents"), "w", _vocabulary(spark, sf_dir, "conversations").withColumnRenamed("w", "entry"), 0.75)
    return found.select(F.col("w").alias("word"), "match", F.when(F.col("match").isNotNull(), F.round("score", 9)).alias("score"))


@query(f"""WITH e AS ({_vocabulary_sql("benchmark")}), w AS ({_vocabulary_sql("documents")}), m AS (SELECT reverse(w) AS bad, w AS good FROM e WHERE length(w) >= 5),
  p AS (SELECT w.w AS word, e.w AS entry, 1.0::DOUBLE - levenshtein(w.w, e.w)::DOUBLE / greatest(length(w.w), length(e.w)) AS sim FROM w JOIN e ON length(e.w) > length(w.w) * 0.75 AND length(w.w) > length(e.w) * 0.75),
  b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, entry) AS n FROM p WHERE sim > 0.75::DOUBLE)
  SELECT w.w AS word, coalesce(m.good, d.w, b.entry, w.w) AS corrected, CASE WHEN m.good IS NOT NULL THEN 'EXACT_MISSPELLING' WHEN d.w IS NOT NULL THEN 'EXACT_DICTIONARY' WHEN b.entry IS NOT NULL THEN 'FUZZY_MATCH' ELSE 'NO_MATCH' END AS method,
    CASE WHEN m.good IS NOT NULL OR d.w IS NOT NULL THEN 1.0::DOUBLE ELSE round(coalesce(b.sim, 0.0::DOUBLE), 9) END AS confidence
  FROM w LEFT JOIN m ON m.bad = w.w LEFT JOIN e d ON d.w = w.w LEFT JOIN b ON b.word = w.w AND b.n = 1""")
def word_correct(spark, sf_dir):
    """Every word of the documents by a table of misreadings, then by the benchmark's vocabulary, exactly and by likeness."""
    entries = _vocabulary(spark, sf_dir, "benchmark").orderBy("w")
    words = lookups.from_table(entries.select("w", F.col("w").alias("right")))
    misread = [(w[::-1], w) for w, _ in words if len(w) >= 5]
    vocabulary = scratch.written(_vocabulary(spark, sf_dir, "documents").withColumnRenamed("w", "word"), "vocabulary")
    found = correct.correct_words(vocabulary, "word", words, misread)
    return found.select("word", "corrected", "method", F.round("confidence", 9).alias("confidence"))


#: (id, name, corrected, method)
FULL_NAMES = [(1, "মুহাম্মদ করীম", "মোহাম্মদ করিম", "WORD_BY_WORD"), (2, "রহিম হোসেন", "রহিম হোসেন", "NO_MATCH"), (3, "abc", "abc", "NOT_A_NAME"), (4, "আহমদ আলি", "আহমেদ আলী", "WORD_BY_WORD"), (5, "ফাতিমা খাতুন বেগম", "ফাতেমা খাতুন বেগম", "WORD_BY_WORD")]


@query(cases_sql([(c, m) for _, _, c, m in FULL_NAMES], ["corrected", "method"]))
def correct_name(spark, sf_dir):
    """Surnames win over first names."""
    d = cases(spark, sf_dir, [(n,) for _, n, _, _ in FULL_NAMES], "name string")
    return correct.correct_names(d, "name", "id").select("id", "corrected", "method")


@query(f"""WITH c AS ({cases_sql([("করিম হোসেন", "মোহাম্মদ আলী"), (None, "ফাতেমা"), (None, None)], ["a", "b"])})
  SELECT id, 'name' AS field, a AS corrected FROM c WHERE a IS NOT NULL UNION ALL SELECT id, 'father', b FROM c WHERE b IS NOT NULL""")
def person_names(spark, sf_dir):
    """Several name fields at once."""
    d = cases(spark, sf_dir, [("করীম হোসেন", "মুহাম্মদ আলি"), ("রহিম", "ফাতিমা"), ("", None)], "name string, father string")
    return correct.correct_person_names(d, "id", ["name", "father"]).select("id", "field", "corrected")


#: Later entries see what earlier ones made.
_MISREAD = [("the", "teh"), ("tion", "sion"), ("and", "und"), ("sion", "cion"), ("ing", "eng"), ("teh", "the"), ("und", "and")]
_STEPS = ", ".join(f"s{k} AS (SELECT *, replace(t{k}, '{a}', '{b}') AS t{k + 1} FROM s{k - 1})" for k, (a, b) in enumerate(_MISREAD))
_FIRED = " + ".join(f"CAST(t{k + 1} <> t{k} AS BIGINT)" for k in range(len(_MISREAD)))


@query(f"WITH s AS (SELECT doc_id, coalesce(text, '') AS t0 FROM documents), {_STEPS.replace('FROM s-1', 'FROM s')} SELECT doc_id, md5(t{len(_MISREAD)}) AS digest, {_FIRED} AS n FROM s{len(_MISREAD) - 1}")
def correct_text_words(spark, sf_dir):
    """C11: whole documents by a table of misreadings in order, and how many entries fired."""
    done = table(spark, sf_dir, "documents").withColumn("r", correct.correct_text("text", _MISREAD))
    return done.select("doc_id", F.md5(F.col("r.corrected").cast("binary")).alias("digest"), F.col("r.n").cast("long").alias("n"))


_KINDS = "CASE p_size % 3 WHEN 0 THEN 'surname' WHEN 1 THEN 'male' ELSE 'female' END"


@query(f"""WITH n AS (SELECT p_partkey AS place, {_KINDS} = 'surname' AS last, p_name AS name, unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_brand)]) AS spelling FROM part),
  r AS (SELECT *, row_number() OVER (PARTITION BY spelling ORDER BY last DESC, place DESC) AS o FROM n) SELECT spelling, name FROM r WHERE o = 1""")
def canonical_map(spark, sf_dir):
    """A table's spellings exploded, surnames over first names."""
    names = table(spark, sf_dir, "part").select(F.expr(_KINDS).alias("kind"), F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.concat(F.split("p_name", " "), F.array(F.lower("p_brand"))).alias("spellings"))
    return lookups.spellings_table(names)


#: (asked, canonical, method)
ASKED = [("চট্টগ্রম", "চট্টগ্রাম", "EXACT_MATCH"), (" খুলনা ", "খুলনা", "EXACT_MATCH"), ("রাজশাহি", "রাজশাহী", "FUZZY_MATCH"), ("xyz", None, "NOT_FOUND"), ("", None, "NOT_FOUND")]


@query(cases_sql([(c, m) for _, c, m in ASKED], ["canonical", "method"]))
def district_validate(spark, sf_dir):
    """J5, C19."""
    d = cases(spark, sf_dir, [(a,) for a, _, _ in ASKED], "district string")
    return correct.validate_districts(d, "district").select("id", "canonical", F.col("district_method").alias("method"))


@query(f"WITH {PEOPLE}, m AS ({values([(d, dict(lookups.DISTRICTS)[d]) for d in PLACES], ['district', 'division'])}) SELECT m.division, count(*) AS n FROM people JOIN m USING (district) GROUP BY m.division")
def division_rollup(spark, sf_dir):
    """People by division."""
    return correct.validate_districts(people(spark, sf_dir).select("id", "district"), "district").groupBy("division").agg(F.count("*").alias("n"))


#: (district, upazila, valid, district, upazila, number of warnings)
ADDRESSES = [("খুলনা", "দৌলতপুর", True, "খুলনা", "দৌলতপুর", 0), ("খুলন", "তেরখাদ", True, "খুলনা", "তেরখাদা", 2), ("xyz", "দৌলতপুর", False, "xyz", "দৌলতপুর", 0), ("ঢাকা", "কোথাও", True, "ঢাকা", "কোথাও", 0), ("", "দৌলতপুর", True, "", "দৌলতপুর", 2), ("সিলেট", "কোথাওনয়", True, "সিলেট", "কোথাওনয়", 1)]


@query(cases_sql([a[2:] for a in ADDRESSES], ["valid", "d", "u", "warnings"]))
def address_validate(spark, sf_dir):
    """An invalid district leaves the upazila alone; districts without data accept any."""
    d = cases(spark, sf_dir, [a[:2] for a in ADDRESSES], "district string, upazila string")
    return correct.validate_addresses(d).select("id", "valid", F.col("corrected_district").alias("d"), F.col("corrected_upazila").alias("u"), F.size("warnings").cast("long").alias("warnings"))


@query(f"WITH {PEOPLE} SELECT id, CASE WHEN contains(upazila || ' উপজেলা ' || district, 'দৌলতপুর') THEN 'দৌলতপুর' WHEN contains(upazila || ' উপজেলা ' || district, 'তেরখাদা') THEN 'তেরখাদা' ELSE upazila || ' উপজেলা ' || district END AS found FROM people")
def contained_upazila(spark, sf_dir):
    """The first listed name inside a longer value."""
    return people(spark, sf_dir).select("id", correct.contained_entry(F.concat_ws(" ", "upazila", F.lit("উপজেলা"), "district"), ["দৌলতপুর", "তেরখাদা"]).alias("found"))


@query("""WITH f AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS id, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey + 1 END AS serial, 'fixed ' || o_orderkey AS name FROM orders WHERE o_orderkey % 5 = 0),
  j AS (SELECT c_custkey, f.name, row_number() OVER (PARTITION BY c_custkey ORDER BY f.position) AS n FROM customer c JOIN f ON f.id = c_custkey OR f.serial = c_custkey)
  SELECT c.c_custkey AS id, coalesce(j.name, c.c_name) AS name FROM customer c LEFT JOIN j ON j.c_custkey = c.c_custkey AND j.n = 1""")
def merge_corrected(spark, sf_dir):
    """By id or serial, the first by position."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("serial"), F.col("c_name").alias("name"))
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0")
    fixed = o.select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("id"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_custkey") + 1).alias("serial"), F.concat(F.lit("fixed "), F.col("o_orderkey").cast("string")).alias("name"))
    return correct.merge_corrected(rows, fixed, ["name"]).select("id", "name")


@query(f"""SELECT {_KINDS} AS what, count(DISTINCT p_name) AS n FROM part GROUP BY 1 UNION ALL
  SELECT 'districts', count(DISTINCT n_name) FROM nation UNION ALL SELECT 'divisions', count(DISTINCT r_name) FROM nation JOIN region ON n_regionkey = r_regionkey""")
def lookup_sizes(spark, sf_dir):
    """A12."""
    names = table(spark, sf_dir, "part").select(F.expr(_KINDS).alias("kind"), F.col("p_name").alias("name"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("district"), F.col("r_name").alias("division"))
    return lookup_stats(names, places)


@query("""SELECT p_partkey, replace(replace(p_name, 'e', 'i'), 'ii', 'y') AS p_name, replace(replace(p_type, 'e', 'i'), 'ii', 'y') AS p_type, replace(replace(p_name, 'e', 'i'), 'ii', 'y') <> p_name OR replace(replace(p_type, 'e', 'i'), 'ii', 'y') <> p_type AS changed FROM part""")
def ordered_replace(spark, sf_dir):
    """Later replacements see what earlier ones made."""
    return repair.replace_parts(table(spark, sf_dir, "part"), ["p_name", "p_type"], [("e", "i"), ("ii", "y")]).select("p_partkey", "p_name", "p_type", "changed")


#: 306 ordered pairs, by a rule: of two different letters the second goes first. Later pairs see what earlier ones made.
_LETTERS = "etaoinshrdlucmfwyg"
LONG_TABLE = [(a + b, b + a) for a in _LETTERS for b in _LETTERS if a != b]
_NESTED = "text"
for _a, _b in LONG_TABLE:
    _NESTED = f"replace({_NESTED}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, md5(r) AS digest, r <> text AS changed FROM (SELECT doc_id, text, {_NESTED} AS r FROM documents)")
def long_replace(spark, sf_dir):
    """An ordered table of 306 pairs over whole documents, by one automaton."""
    done = repair.replace_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], LONG_TABLE)
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "changed")


_JOB = [("ee", "i"), ("small", "tiny"), ("i", "y"), ("red", "crimson")]
_DONE = "replace(replace(replace(replace({0}, 'ee', 'i'), 'small', 'tiny'), 'i', 'y'), 'red', 'crimson')"


@query(f"SELECT p_partkey, {_DONE.format('p_name')} AS p_name, {_DONE.format('p_type')} AS p_type, {_DONE.format('p_name')} <> p_name OR {_DONE.format('p_type')} <> p_type AS changed FROM part")
def repair_job(spark, sf_dir):
    """A job in parts that was stopped and went on; the repaired table."""
    work, parts = scratch.path(spark, "job"), table(spark, sf_dir, "part")
    jobs.replace_job(spark, work, ["p_name", "p_type"], _JOB, "p_partkey", parts=4).run(parts, most=2)
    again = jobs.replace_job(spark, work, ["p_name", "p_type"], _JOB, "p_partkey", parts=4)
    again.run(parts)
    return again.result().select("p_partkey", "p_name", "p_type", "changed")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSES' WHEN 'MACHINERY' THEN 'TOOLS' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def equality_replace(spark, sf_dir):
    """Whole values by a table."""
    return repair.replace_values(table(spark, sf_dir, "customer"), ["c_mktsegment"], {"BUILDING": "HOUSES", "MACHINERY": "TOOLS"}).select("c_custkey", "c_mktsegment")


@query("SELECT CAST(sum((length(p_name) - length(replace(p_name, 'ee', ''))) / 2 + (length(p_type) - length(replace(p_type, 'ee', ''))) / 2) AS BIGINT) AS n FROM part")
def occurrences(spark, sf_dir):
    """A15."""
    return repair.occurrences(table(spark, sf_dir, "part"), ["p_name", "p_type"], "ee")


@query("""WITH a AS (SELECT p_partkey, unnest(['p_name', 'p_brand']) AS field, unnest([p_name, p_brand]) AS was, unnest([replace(p_name, 'red', 'blue'), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE replace(p_brand, '1', '9') END]) AS now FROM part) SELECT * FROM a WHERE now <> '' AND now <> was""")
def row_diff(spark, sf_dir):
    """Filled fields that differ."""
    old = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    new = old.select("p_partkey", F.replace("p_name", F.lit("red"), F.lit("blue")).alias("p_name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.replace("p_brand", F.lit("1"), F.lit("9"))).alias("p_brand"))
    return repair.differences(old, new, "p_partkey", ["p_name", "p_brand"])


#: Records with what is wrong in them.
RECORDS = [(1, "করীম হোসেন", "রহিম আলী", "বগম", "কৃযক", "খুলন", "দৌলতপুর"), (2, "রহিম আলী", "কামাল হোসেন", "সালমা বেগম", "শিক্ষক", "খুলনা", "দৌলতপুর"), (3, "abc", "", None, "", "xyz", "")]
_FIXED = [(1, "করিম হোসেন", "বেগম", "কৃষক", "খুলনা", 2, 1, 1), (2, "রহিম আলী", "সালমা বেগম", "শিক্ষক", "খুলনা", 0, 0, 0), (3, "abc", None, "", "xyz", 0, 0, 0)]


def _records(spark, sf_dir):
    return cases(spark, sf_dir, [r[1:] for r in RECORDS], "name string, father string, mother string, occupation string, district string, upazila string")


@query(cases_sql([r[1:] for r in _FIXED], ["name", "mother", "occupation", "district", "n_dict", "n_name", "n_geo"]))
def corrections(spark, sf_dir):
    """Misreadings, names, places, with counts by kind."""
    d = repair.corrected(_records(spark, sf_dir))
    return d.select("id", "name", "mother", "occupation", "district", *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in ("dict", "name", "geo")])


@query(f"""WITH c AS ({cases_sql([r[5:] for r in _FIXED], ["d", "n", "g"])}), s AS (SELECT count(*) AS processed, count_if(d + n + g > 0) AS modified, sum(d) AS d, sum(n) AS n, sum(g) AS g FROM c)
  SELECT processed, modified, CAST(d AS BIGINT) AS dict, CAST(n AS BIGINT) AS name, CAST(g AS BIGINT) AS geo, CAST(d + n + g AS BIGINT) AS total FROM s""")
def repair_summary(spark, sf_dir):
    """A10, A11, U3."""
    return repair.repair(_records(spark, sf_dir))[1].select("processed", "modified", "dict", "name", "geo", "total")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def outside_corrections(spark, sf_dir):
    """Batches through an outside corrector."""
    return repair.outside_corrections(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), _shout, ["c_mktsegment"])


def _shout(rows: list[dict]) -> list[dict]:
    return [{"c_mktsegment": r["c_mktsegment"].upper() + "!"} if r["c_custkey"] % 2 == 0 else {} for r in rows]

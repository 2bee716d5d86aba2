"""Search queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nothi.functions import names
from nothi.functions.similarity import jaccard, ngrams
from nothi.operators import postings, search
from nothi.plans.registry import PEOPLE, grams_sql, jaccard_sql, key_sql, match_sql, people, query, quote, table
from nothi.sources import scratch

NAME, TWO_WORDS, VILLAGE = "করীম", "হোসেন রহিম", "গ্রাম"
_FIELDS = ["id", "name", "father", "village"]


def _keyed(spark, sf_dir):
    return search.with_keys(people(spark, sf_dir))


def _page(where: str, page: int, size: int, columns: str = "id, name, father, village") -> str:
    return f"WITH {PEOPLE} SELECT {columns} FROM people WHERE {where} ORDER BY k LIMIT {size} OFFSET {(page - 1) * size}"


@query(_page(match_sql("name", NAME), 1, 20))
def phonetic_search(spark, sf_dir):
    """A page of the people whose name sounds like the term."""
    page, _ = search.search(_keyed(spark, sf_dir), ["k"], page=1, limit=20, name=NAME)
    return page.select(*_FIELDS)


@query(_page(match_sql("name", TWO_WORDS), 1, 50))
def phonetic_search_multiword(spark, sf_dir):
    """all words of the term, in any order."""
    return search.search(_keyed(spark, sf_dir), ["k"], page=1, limit=50, name=TWO_WORDS)[0].select(*_FIELDS)


@query(_page(f"({match_sql('village', VILLAGE)} OR {match_sql('area', VILLAGE)})", 2, 30))
def village_or_area_search(spark, sf_dir):
    """one term against two columns."""
    return search.search(_keyed(spark, sf_dir), ["k"], page=2, limit=30, village=VILLAGE)[0].select(*_FIELDS)


@query(f"WITH {PEOPLE} SELECT id, name, father, village FROM people WHERE name ILIKE '%খা%' AND (village ILIKE '%পাড়া%' OR area ILIKE '%পাড়া%') AND district = 'খুলনা' ORDER BY k DESC LIMIT 25")
def ilike_search(spark, sf_dir):
    """the database's mode."""
    hits = people(spark, sf_dir).filter(search.predicate("ilike", name="খা", village="পাড়া", district="খুলনা"))
    return search.paged(hits, [F.col("k").desc()], 1, 25).select(*_FIELDS)


@query(f"WITH {PEOPLE} SELECT count(*) AS total FROM people WHERE {match_sql('name', NAME)} AND gender = 'মহিলা'")
def search_count(spark, sf_dir):
    """A1, F8: matches before paging."""
    return search.search(_keyed(spark, sf_dir), ["k"], name=NAME, gender="female")[1]


@query(_page("true", 2, 200))
def search_page_clamped(spark, sf_dir):
    """O1: page ``2abc`` is 2, 500 rows a page are 200; blank fields ask nothing."""
    return search.search(_keyed(spark, sf_dir), ["k"], page="2abc", limit=500, name="  ", gender="all")[0].select(*_FIELDS)


@query(f"WITH {PEOPLE} SELECT id, nid, number FROM people WHERE contains(number, '37') AND {match_sql('occupation', 'শিক্ষক')} AND {match_sql('mother', 'হাসান')}")
def number_and_job_search(spark, sf_dir):
    """a part of the number, and two phonetic fields."""
    return _keyed(spark, sf_dir).filter(search.predicate(number="37", occupation="শিক্ষক", mother="হাসান")).select("id", "nid", "number")


@query(f"WITH {PEOPLE} SELECT id, nid FROM people WHERE nid = lpad(CAST(7919 * 12 AS VARCHAR), 10, '1')")
def nid_search(spark, sf_dir):
    """equality."""
    return _keyed(spark, sf_dir).filter(search.predicate(nid=str(7919 * 12).rjust(10, "1"))).select("id", "nid")


@query(f"WITH {PEOPLE} SELECT id, name, father, mother FROM people WHERE contains(name, 'আমেনা') OR contains(father, 'আমেনা') OR contains(mother, 'আমেনা')")
def any_column_search(spark, sf_dir):
    """a part of any of three columns."""
    return people(spark, sf_dir).filter(search.any_column_contains(["name", "father", "mother"], "আমেনা")).select("id", "name", "father", "mother")


@query(f"WITH {PEOPLE} SELECT id, name FROM people WHERE id IN ('p3', 'p5', 'p700')")
def filter_by_ids(spark, sf_dir):
    """F11."""
    return people(spark, sf_dir).filter(F.col("id").isin("p3", "p5", "p700")).select("id", "name")


_TERM = "small red"


@query(f"""WITH p AS (SELECT p_partkey, p_name, {key_sql('p_name')} AS key FROM part), g AS (SELECT *, {grams_sql('key')} AS grams, {grams_sql(quote(_TERM))} AS asked FROM p),
  j AS (SELECT *, {jaccard_sql('grams', 'asked')} AS jac FROM g),
  m AS (SELECT *, CASE WHEN coalesce(p_name, '') = '' THEN 'none' WHEN p_name = {quote(_TERM)} THEN 'exact' WHEN contains(p_name, {quote(_TERM)}) THEN 'partial' WHEN contains(key, {quote(_TERM)}) THEN 'phonetic'
    WHEN contains(key, 'small') AND contains(key, 'red') THEN 'phonetic_multiword' WHEN jac >= 0.35 THEN 'fuzzy_ngram' ELSE 'none' END AS method FROM j)
  SELECT p_partkey, method <> 'none' AS matched, CASE method WHEN 'exact' THEN CAST(1 AS DOUBLE) WHEN 'partial' THEN CAST(0.95 AS DOUBLE) WHEN 'phonetic' THEN CAST(0.85 AS DOUBLE) WHEN 'phonetic_multiword' THEN CAST(0.8 AS DOUBLE) WHEN 'fuzzy_ngram' THEN jac ELSE CAST(0 AS DOUBLE) END AS score, method FROM m""")
def multimode_match(spark, sf_dir):
    """the first mode that hits, with its score."""
    p = search.with_keys(table(spark, sf_dir, "part").withColumnRenamed("p_name", "name"), ("name",)).withColumn("grams", ngrams("key_name", 2))
    return p.withColumn("m", search.multi_mode("name", "key_name", "grams", _TERM)).select("p_partkey", "m.matched", "m.score", "m.method")


_ASKED = ["red", "steel", "a"]


@query(f"WITH q AS (SELECT unnest([{', '.join(map(quote, _ASKED))}]) AS q), g AS (SELECT p_partkey, q, {grams_sql('p_name')} AS a, {grams_sql('q')} AS b FROM part, q) SELECT p_partkey, q, round({jaccard_sql('a', 'b')}, 9) AS j FROM g")
def ngram_jaccard(spark, sf_dir):
    """Bigram likeness of every part's name to some terms."""
    p = table(spark, sf_dir, "part").select("p_partkey", ngrams("p_name", 2).alias("a"), F.explode(F.array(*map(F.lit, _ASKED))).alias("q"))
    return p.select("p_partkey", "q", F.round(jaccard(F.col("a"), ngrams("q", 2)), 9).alias("j"))


@query(f"WITH {PEOPLE} SELECT id, {', '.join(f'{key_sql(c)} AS key_{c}' for c in search.KEYED)}, array_to_string(list_sort({grams_sql(key_sql('name'))}), ',') AS grams_name, array_to_string(list_sort({grams_sql(key_sql('father'))}), ',') AS grams_father FROM people")
def search_index(spark, sf_dir):
    """The key columns and bigrams that are written at ingest."""
    p = search.with_index(people(spark, sf_dir))
    return p.select("id", *[f"key_{c}" for c in search.KEYED], *[F.array_join(F.sort_array(f"grams_{c}"), ",").alias(f"grams_{c}") for c in ("name", "father")])


_TERMS = [("name", "করীম"), ("name", "হোসেন রহিম"), ("father", "সালমা"), ("village", "পূর্ব পা"), ("name", "শ"), ("name", "নেই এমন")]
_HITS = " UNION ALL ".join(f"SELECT {quote(c)} AS field, {quote(t)} AS term, id FROM people WHERE {match_sql(c, t)}" for c, t in _TERMS)


def _indexed(spark, sf_dir):
    p = _keyed(spark, sf_dir)
    return p, postings.write(p, "id", ("name", "father", "village"), scratch.path(spark, "postings"))


@query(f"WITH {PEOPLE} {_HITS}")
def postings_search(spark, sf_dir):
    """C4, F2: the phonetic search by the written index of bigrams."""
    p, index = _indexed(spark, sf_dir)
    found = [index.matching(p, c, t).select(F.lit(c).alias("field"), F.lit(t).alias("term"), "id") for c, t in _TERMS]
    return reduce(DataFrame.unionByName, found)


_ALIKE = [("করিমা হোসেন", 0.35), ("রহিম আলী", 0.6)]


@query(f"WITH {PEOPLE}, g AS (SELECT id, {grams_sql(key_sql('name'))} AS a FROM people) " + " UNION ALL ".join(f"SELECT {quote(t)} AS term, id, round({jaccard_sql('a', grams_sql(quote(search.key_of(t))))}, 9) AS score FROM g WHERE {jaccard_sql('a', grams_sql(quote(search.key_of(t))))} >= {x}::DOUBLE" for t, x in _ALIKE))
def postings_alike(spark, sf_dir):
    """The fuzzy mode by the index."""
    p, index = _indexed(spark, sf_dir)
    return reduce(DataFrame.unionByName, [index.alike(p, "name", t, x).select(F.lit(t).alias("term"), "id", F.round("score", 9).alias("score")) for t, x in _ALIKE])


_BN = "len(regexp_extract_all(coalesce({0}, ''), '[\\x{{0980}}-\\x{{09FF}}]'))"
_LIKELY = f"""length(coalesce(s, '')) > 0 AND len(string_split_regex(trim(s), '\\s+')) <= 5 AND len([w for w in string_split_regex(trim(s), '\\s+') if length(w) < 2 OR length(w) > 20]) = 0
  AND {_BN.format('s')} > 0 AND length(s) - {_BN.format('s')} <= CAST(0.2 AS DOUBLE) * length(s)"""


@query(f"WITH {PEOPLE}, v AS (SELECT id, CASE k % 4 WHEN 0 THEN name WHEN 1 THEN father WHEN 2 THEN name || ' abc' ELSE mother END AS s FROM people) SELECT id, coalesce({_LIKELY}, false) AS likely FROM v")
def likely_names(spark, sf_dir):
    """F15."""
    v = people(spark, sf_dir).withColumn("s", F.when(F.col("k") % 4 == 0, F.col("name")).when(F.col("k") % 4 == 1, F.col("father")).when(F.col("k") % 4 == 2, F.concat("name", F.lit(" abc"))).otherwise(F.col("mother")))
    return v.select("id", names.is_likely_name("s").alias("likely"))


@query(f"WITH {PEOPLE} SELECT id, CASE WHEN contains(name, ' ') THEN regexp_replace(name, '\\s+\\S+$', '') ELSE name END AS first_name, CASE WHEN contains(name, ' ') THEN regexp_extract(name, '\\S+$') ELSE '' END AS surname, name AS joined FROM people")
def name_parts(spark, sf_dir):
    """Split and joined again."""
    p = people(spark, sf_dir).withColumn("n", names.split_name("name"))
    return p.select("id", "n.first_name", "n.surname", names.join_name(F.col("n.first_name"), F.col("n.surname")).alias("joined"))


@query(f"""WITH {PEOPLE} SELECT id, coalesce(trim(name), '') <> '' AS valid, array_to_string(list_filter([CASE WHEN coalesce(trim(father), '') = '' THEN 'Missing father name' END, CASE WHEN coalesce(trim(mother), '') = '' THEN 'Missing mother name' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM people""")
def name_structure(spark, sf_dir):
    """F16."""
    return people(spark, sf_dir).withColumn("s", names.name_structure("name", "father", "mother")).select("id", "s.valid", F.array_join("s.warnings", "; ").alias("warnings"))


def _points(c: str, most: int) -> str:
    return f"CASE WHEN length(coalesce({c}, '')) > 2 THEN least({most}, coalesce(CAST(floor(CAST({_BN.format(c)} * {most} AS DOUBLE) / nullif(length(regexp_replace({c}, '\\s', '', 'g')), 0) + 0.5) AS BIGINT), 0)) ELSE 0 END"


@query(f"""WITH {PEOPLE}, s AS (SELECT id, {_points('name', 40)} + {_points('father', 15)} + CASE WHEN length(coalesce(mother, '')) > 2 THEN 10 ELSE 0 END + CASE WHEN regexp_full_match(number, '[0-9]{{5,}}') THEN 15 ELSE 0 END
  + CASE WHEN regexp_full_match(nid, '[0-9]{{10,17}}') THEN 10 ELSE 0 END + CASE WHEN district <> '' THEN 3 ELSE 0 END + CASE WHEN upazila <> '' THEN 3 ELSE 0 END + CASE WHEN coalesce(village, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(area, '') <> '' THEN 2 ELSE 0 END AS score FROM people)
  SELECT id, CAST(least(100, score) AS BIGINT) AS score, CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD' WHEN score >= 40 THEN 'FAIR' ELSE 'POOR' END AS level FROM s""")
def quality_score(spark, sf_dir):
    """C36."""
    return people(spark, sf_dir).withColumn("q", names.quality(ward="area")).select("id", F.col("q.score").cast("bigint").alias("score"), "q.level")

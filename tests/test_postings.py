"""The index gives the rows that a scan gives, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from nothi.functions.similarity import ngrams
from nothi.operators import postings, search
from nothi.sources import scratch

LETTERS = "করমসহনিীাে শ"


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(LETTERS.replace(" ", ""), k=rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 3)))) for i in range(1500)] + [(9000, None), (9001, ""), (9002, "a"), (9003, "Ab aB"), (9004, "করিম  করিম")]
    return search.with_keys(spark.createDataFrame(rows, "id long, name string"), ("name",)).cache()


@pytest.fixture(scope="module")
def index(spark, people):
    half = people.filter("id % 2 = 0")
    return postings.write(half, "id", ["name"], scratch.path(spark, "p"), buckets=16, rows_a_file=200).add(people.filter("id % 2 = 1"), rows_a_file=200)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize("term", ["করিম", "রস", "শ", "ক ম", "রম হস", "aB", "ab a", "নেইএমন", "", "হহহ", "করিম  করিম", "িা"])
def test_parts(people, index, term):
    assert ids(index.matching(people, "name", term)) == ids(people.filter(search.matches("name", "key_name", term)))


@pytest.mark.parametrize("term, threshold", [("করিম", 0.35), ("রসমহ কন", 0.2), ("শহর", 0.5), ("শহর", 1.0), ("ক", 0.35), ("নেইএমন", 0.35), ("করিম", 0.0)])
def test_alike(people, index, term, threshold):
    scan = search.jaccard(ngrams("key_name", 2), ngrams(F.lit(search.key_of(term)), 2)) >= threshold
    assert ids(index.alike(people, "name", term, threshold)) == ids(people.filter(scan))


def test_many_candidates_are_joined(people, index, monkeypatch):
    want = ids(index.matching(people, "name", "রস"))
    monkeypatch.setattr(postings, "LISTED", 3)
    assert len(want) > 3 and ids(index.matching(people, "name", "রস")) == want


def test_common_bigrams_are_split_and_rare_ones_open_few_files(spark, people, index):
    rows = spark.read.parquet(f"{index.path}/postings").withColumn("file", F.input_file_name())
    assert rows.groupBy("file").count().agg(F.max("count")).first()[0] <= 200
    held = rows.groupBy("field", "gram").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    assert held.agg(F.max("n")).first()[0] > 200 or held.agg(F.max("files")).first()[0] > 1
    everything = rows.select("file").distinct().count()
    few = held.orderBy("n", "gram").first()
    assert postings.files_read(index, {(few.field, few.gram)}) <= 2 < everything / 4
    plan = index._asked("postings", {(few.field, few.gram)})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters:")[1].split("]")[0] and "EqualTo(field" in plan


def test_rare_bigrams_stand_for_a_term(index):
    n = index.counts({("key_name", g) for g in postings.grams_of(search.key_of("করমসহন"))})
    assert len(n) == 5 and all(v > 0 for v in n.values()) and index.counts({("key_name", "zz")}) == {("key_name", "zz"): 0}


def test_nothing_indexed(spark, people):
    none = people.limit(0)
    index = postings.write(none, "id", ["name"], scratch.path(spark, "e"))
    assert ids(index.matching(none, "name", "শ")) == []


def test_rows_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, "name", 2, "ab", 0), (2, "name", 2, "ab", 0)], "id long, field string, n int, gram string, bucket int")
    counts = rows.groupBy("bucket", "field", "gram").count().withColumnRenamed("count", "records")
    plan = postings._dealt(rows, counts, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan

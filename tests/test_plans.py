"""Plans are the ones that hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from nothi.operators import correct, search
from nothi.plans import catalog
from nothi.sources import scratch, store


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def people(spark, sf_dir):
    from nothi.plans.registry import people as made

    path = scratch.path(spark, "people")
    search.with_index(made(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def test_a_search_is_one_pruned_scan(people):
    p = plan(people.filter(search.predicate(name="করীম", district="খুলনা", nid="1")).select("id"))
    assert "Exchange" not in p and "Python" not in p
    assert re.search(r"PushedFilters: .*StringContains\(key_name", p) and "EqualTo(nid" in p
    read = re.search(r"ReadSchema: (.*)", p)[1]
    assert "mother" not in read and "grams" not in read


def test_a_page_is_a_bounded_sort(people):
    page, _ = search.search(people, ["k"], page=1, limit=20, name="করীম")
    assert "TakeOrderedAndProject" in plan(page)


def test_text_functions_stay_in_code_generation(spark, sf_dir):
    for name in ("search_keys", "encoding_detect", "digits_bn", "quality_score", "keep_bengali"):
        p = plan(catalog.queries()[name](spark, sf_dir))
        assert "Python" not in p and "Arrow" not in p and "Pandas" not in p


def test_no_query_pairs_all_rows(spark, sf_dir):
    for name, q in catalog.queries().items():
        if name not in ("log_stream",):
            p = plan(q(spark, sf_dir))
            assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_fuzzy_matching_compares_distinct_words(spark):
    words = spark.range(1000).select(F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("w"))
    p = plan(correct.correct_words(words, "w"))
    assert "HashAggregate" in p and "CartesianProduct" not in p


def test_keyed_changes_are_joins(spark):
    d = spark.range(10).withColumnRenamed("id", "k")
    assert "LeftAnti" in plan(store.without_ids(d, d.limit(2), "k"))

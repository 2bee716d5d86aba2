import pytest
from pyspark.sql import functions as F

from nothi.llm import op3_mixing as op3
from tests.compare import connect, same
from tests.llm.helpers import docs, empty


def test_against_sql(spark, sf_dir):
    assert same(op3.op3_mixing(spark, sf_dir), op3.SQL, connect(sf_dir)) > 0


def test_weights_meet_the_targets(spark):
    cells = spark.createDataFrame([(s, l, t, float(10 + 7 * i)) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "mn")], "source string, lang string, topic string, tokens double")
    targets = {"source": [("a", 0.5), ("b", 0.3), ("c", 0.2)], "lang": [("x", 0.9), ("y", 0.1)], "topic": [("m", 0.5), ("n", 0.5)]}
    out = op3.rake(cells, {m: spark.createDataFrame(r, f"{m} string, target double") for m, r in targets.items()}, keep=0.2)
    rows = out.collect()
    whole = sum(r.tokens for r in rows)
    for m, want in targets.items():
        for value, share in want:
            assert sum(r.w for r in rows if r[m] == value) / whole == pytest.approx(share, abs=1e-9)
    assert all(r.p == pytest.approx(min(1.0, 0.2 * r.w / r.tokens)) for r in rows)


def test_sample_follows_the_probabilities(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 10 == 0, "en").otherwise("de").alias("lang"), F.lit("s").alias("source"), F.lit(7).alias("n_chars"))
    kept = op3.sample_mixture(d, {"lang": spark.createDataFrame([("en", 0.15), ("de", 0.85)], "lang string, target double")})
    n = dict(kept.groupBy("lang").count().collect())
    assert kept.columns == d.columns
    assert n["en"] == pytest.approx(0.5 * 0.15 * 20_000, rel=0.06) and n["de"] == pytest.approx(0.5 * 0.85 * 20_000, rel=0.03)


def test_odd_rows(spark):
    out = op3.mix(docs(spark)).collect()
    assert len(out) == 9 and all(0 <= r.p <= 1 for r in out)
    assert {(r.source, r.lang) for r in out if r.doc_id == 3} == {("(none)", "(none)")}
    twice = [r for r in out if r.doc_id == 1]
    assert twice[0] == twice[1]
    again = op3.mix(docs(spark)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert op3.sample_mixture(docs(spark)).columns == docs(spark).columns


def test_empty(spark):
    assert op3.mix(empty(spark)).count() == 0 and op3.sample_mixture(empty(spark)).count() == 0
    assert op3.mix(docs(spark, [(1, None, "en", "a", 0)])).head().p == op3.KEEP


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = op3.op3_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_targets_that_no_weights_meet(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10.0), ("b", "y", "t", 10.0)], "source string, lang string, topic string, tokens double")
    targets = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, target double")}
    with pytest.warns(UserWarning, match="do not agree"):
        op3.rake(cells, targets, rounds=3)

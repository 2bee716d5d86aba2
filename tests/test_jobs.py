"""Jobs that are stopped and go on."""

import pytest
from pyspark.sql import functions as F

from nothi.plans import jobs, repair
from nothi.sources import scratch
from nothi.sources.versions import Versioned

RECORDS = [(i, ["করীম হোসেন", "রহিম আলী", "abc", None][i % 4], "বগম", ["খুলন", "খুলনা", ""][i % 3], "দৌলতপুর") for i in range(40)]
SCHEMA = "id int, name string, mother string, district string, upazila string"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_stopped_repair_goes_on(spark):
    table, work = spark.createDataFrame(RECORDS, SCHEMA), scratch.path(spark, "w")
    job = jobs.repair_job(spark, work, parts=3)
    assert not job.run(table, most=1) and job.progress().count() == 1
    with pytest.raises(RuntimeError):
        job.result()

    class Stop(Exception):
        pass

    def dies(df):
        raise Stop

    # A part that was begun: rows without progress.
    broken = jobs.Job(spark, work, dies, parts=3)
    with pytest.raises(Stop):
        broken.run(table)
    again = jobs.repair_job(spark, work, parts=3)
    assert again.run(table) and again.run(table)
    want = repair.with_keys(repair.corrected(table)).withColumn("changed", F.col("n_dict") + F.col("n_name") + F.col("n_geo") > 0)
    got = again.result()
    assert rows(got.select(*want.columns)) == rows(want)
    assert again.summary().first().processed == 40 == again.dry_run(table).first().processed


def test_a_dry_run_sees_names_as_read(spark):
    """A misread name that only its corrected form makes a known one."""
    table = spark.createDataFrame([(1, "বগম"), (2, "করীম")], "id int, name string")
    count = lambda **k: {r.id: (r.n_dict, r.n_name) for r in repair.corrected(table, **k).collect()}
    assert count()[2] == count(names_as_read=True)[2] == (0, 1)
    assert count()[1] == (1, 0) and count(names_as_read=True)[1][0] == 1


def test_a_dry_run_writes_nothing(spark):
    work = scratch.path(spark, "d")
    job = jobs.replace_job(spark, work, ["s"], [("a", "b")], "id")
    table = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, s string")
    assert tuple(job.dry_run(table).first()) == (3, 1) and job.progress().count() == 0 and job.log.versions() == []


def test_a_part_that_two_runs_did_counts_once(spark):
    table, work = spark.createDataFrame([(i, "a") for i in range(20)], "id int, s string"), scratch.path(spark, "t")
    one, two = (jobs.replace_job(spark, work, ["s"], [("a", "b")], "id", parts=2) for _ in range(2))
    two._todo = lambda: [0, 1]
    one.run(table)
    two.run(table)
    assert one.log.read().count() == 4 and one.progress().count() == 2 and one.result().count() == 20


def test_reparse_replaces_whole_sources_once(spark):
    records = Versioned(spark, scratch.path(spark, "r"))
    records.commit(spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "doc string, name string"))
    sources = spark.createDataFrame([("a", "x y"), ("b", ""), ("d", "z")], "doc string, text string")
    parse = lambda df: df.select("doc", F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("name"))
    assert jobs.reparse(records, sources, parse, scratch.path(spark, "rw"), parts=2) == 2
    assert sorted(map(tuple, records.read().collect())) == [("a", "x"), ("a", "y"), ("b", "old"), ("c", "old"), ("d", "z")]

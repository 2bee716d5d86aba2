"""The database back end on the embedded database that Spark ships."""

import uuid

import pytest

from nothi.sources import backends, store

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture
def url(spark):
    name = f"jdbc:derby:memory:{uuid.uuid4().hex}"
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(DRIVER)
    except Exception:  # noqa: BLE001
        pytest.skip("no embedded database")
    yield f"{name};create=true"


def people(spark, ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], "ID int, NAME string")


def test_read_append_and_replace(spark, url):
    db = backends.choose("", url, driver=DRIVER)
    db.replace(people(spark, range(10)), "PEOPLE")
    db.append(people(spark, range(10, 25)), "PEOPLE")
    assert sorted(r.ID for r in db.read(spark, "PEOPLE").collect()) == list(range(25))
    db.replace(people(spark, [7]), "PEOPLE")
    assert [tuple(r) for r in db.read(spark, "PEOPLE").collect()] == [(7, "n7")]


def test_reading_in_parts_with_filters_in_the_database(spark, url):
    store.write_jdbc(people(spark, range(100)), url, "PEOPLE", driver=DRIVER)
    df = store.read_jdbc(spark, url, "PEOPLE", by="ID", parts=4, driver=DRIVER)
    assert df.rdd.getNumPartitions() == 4 and sorted(r.ID for r in df.collect()) == list(range(100))
    few = df.filter("ID > 90 and ID <> 95").select("NAME")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(ID,90)" in plan.replace("*", "") and len(few.collect()) == 8
    store.write_jdbc(people(spark, []), url, "NOBODY", driver=DRIVER)
    assert store.read_jdbc(spark, url, "NOBODY", by="ID", driver=DRIVER).count() == 0


def test_a_failing_batch_stops_the_rest(spark, url):
    store.write_jdbc(people(spark, [50]), url, "PEOPLE", driver=DRIVER)
    jvm = spark.sparkContext._jvm
    connection = jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().execute("CREATE UNIQUE INDEX ONE ON PEOPLE(ID)")
    connection.close()
    with pytest.raises(store.FailedBatch) as stopped:
        store.write_jdbc_in_order(people(spark, range(100)), url, "PEOPLE", "ID", groups=10, driver=DRIVER)
    there = sorted(r.ID for r in store.read_jdbc(spark, url, "PEOPLE", driver=DRIVER).collect())
    assert there == [*range(stopped.value.written), 50] and 30 <= stopped.value.written <= 50
    assert store.write_jdbc_in_order(people(spark, range(100, 120)), url, "PEOPLE", "ID", groups=3, driver=DRIVER) == 20

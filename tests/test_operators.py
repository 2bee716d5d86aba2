"""Edge cases of the operators: empty tables, nulls, ties, order."""

import pytest
from pyspark.sql import functions as F

from nothi.operators import correct, detect, extract, layout, search
from nothi.plans import repair
from nothi.sources import scratch, store, versions
from nothi.streaming import activity

ITEM = "doc string, page int, seq int, str string, x double, y double, width double, height double"
LINE = "doc string, page int, column int, line int, text string, x double, y double, width double, height double"


def test_search_over_nothing(spark):
    d = search.with_keys(spark.createDataFrame([], "id int, name string, father string, gender string"))
    page, total = search.search(d, ["id"], name="x")
    assert page.count() == 0 and total.head().total == 0


def test_search_with_nulls(spark):
    d = search.with_keys(spark.createDataFrame([(1, None), (2, ""), (3, "করিম")], "id int, name string"))
    assert [r.id for r in d.filter(search.predicate(name="করীম")).collect()] == [3]
    assert d.filter(search.predicate(name=" ", nid=None)).count() == 3


def test_ilike_wildcards(spark):
    d = spark.createDataFrame([("axb",), ("AB",), ("a_b",)], "name string")
    assert d.filter(search.predicate("ilike", name="a_b")).count() == 2


def test_first_of_equals_wins(spark):
    d = spark.createDataFrame([("abcd",)], "w string")
    assert correct.best_match(d, "w", ["abcx", "abcy"], 0.5).head().match == "abcx"
    assert correct.best_match(d, "w", ["abcy", "abcx"], 0.5).head().match == "abcy"
    assert correct.best_match(d, "w", ["abcx"], 0.75).head().match is None
    assert correct.best_match(d, "w", [], 0.5).head().match is None


def test_words_keep_rows(spark):
    d = spark.createDataFrame([("শখ", 1), (None, 2), ("", 3), ("শখ", 4)], "w string, n int")
    out = {r.n: (r.corrected, r.method) for r in correct.correct_words(d, "w").collect()}
    assert out[1] == out[4] == ("শেখ", "EXACT_MISSPELLING") and out[2] == (None, "NO_MATCH") and out[3][1] == "NO_MATCH"


def test_names_with_nulls(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "করীম")], "id int, n string")
    out = {r.id: (r.corrected, r.method, r.n) for r in correct.correct_names(d, "n", "id").collect()}
    assert out == {1: ("", "NOT_A_NAME", 0), 2: ("", "NOT_A_NAME", 0), 3: ("করিম", "WORD_BY_WORD", 1)}


def test_misread_words_are_whole(spark):
    texts = [("বগম বগম", "বেগম বেগম", 1), ("বগমপুর", "বগমপুর", 0), ("নিবাচন কিমশন", "নির্বাচন কমিশন", 2), ("", "", 0), ("ভাটার তািলকা।", "ভোটার তালিকা।", 2)]
    d = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "i int, t string")
    assert {r.i: (r.r.corrected, r.r.n) for r in d.select("i", correct.correct_text("t").alias("r")).collect()} == {i: (c, n) for i, (_, c, n) in enumerate(texts)}
    words = [("শখ", "শেখ", "EXACT_MISSPELLING"), ("কমিশন", "কমিশন", "EXACT_DICTIONARY"), ("নির্বাচনে", "নির্বাচন", "FUZZY_MATCH"), ("তালীকা", "তালিকা", "FUZZY_MATCH"), ("xyz", "xyz", "NO_MATCH")]
    d = spark.createDataFrame([(w,) for w, _, _ in words], "word string")
    assert {(r.word, r.corrected, r.method) for r in correct.correct_words(d, "word").collect()} == set(words)


def test_fold_order(spark):
    assert correct.correct_text is not None
    d = spark.createDataFrame([("a",)], "t string")
    assert d.select(correct.correct_text("t", [("a", "b"), ("b", "c")])).head()[0].corrected == "c"
    assert d.select(correct.correct_text("t", [("b", "c"), ("a", "b")])).head()[0].corrected == "b"


@pytest.mark.parametrize("ys, groups", [([100.0, 97.0, 94.0, 91.0], [1, 1, 2, 2]), ([5.0], [1]), ([10.0, 10.0, 6.0], [1, 1, 1])])
def test_line_groups(spark, ys, groups):
    d = spark.createDataFrame([("d", 1, i, "s", float(i), y, 1.0, 1.0) for i, y in enumerate(ys)], ITEM)
    assert [r.line for r in layout.line_groups(d, ["doc"]).orderBy("seq").collect()] == groups


def test_lines_and_columns_over_nothing(spark):
    d = spark.createDataFrame([], ITEM)
    assert layout.columns(d).count() == 0 and layout.lines(d, ["doc", "page"]).count() == 0


def test_columns(spark):
    wide = [("d", 1, i, "s", float(x), 1.0, 10.0, 1.0) for i, x in enumerate([0, 5, 200, 205, 400, 405, 600])]
    narrow = [("e", 1, i, "s", float(x), 1.0, 10.0, 1.0) for i, x in enumerate([0, 50, 149])]
    out = layout.columns(spark.createDataFrame(wide + narrow, ITEM))
    assert [r.column for r in out.filter("doc = 'd'").orderBy("seq").collect()][0] == 1
    assert {r.column for r in out.filter("doc = 'e'").collect()} == {1}
    assert out.filter("doc = 'd'").agg(F.max("column")).head()[0] == 3


def test_records(spark):
    texts = ["০১. করিম", "পিতা: রহিম", "০২ নোটিশ", "০৩. সালমা", "কিছু না"]
    d = spark.createDataFrame([("d", 3, 1, i, t, 0.0, 0.0, 1.0, 1.0) for i, t in enumerate(texts)], LINE)
    assert [(r.serial, r.name, r.father) for r in extract.records(d).collect()] == [("০১", "করিম", "রহিম")]
    assert extract.records(d.limit(0)).count() == 0


def cover(spark, texts):
    d = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, line int, text string")
    return extract.cover_meta(d, {"খুলনা": ["দৌলতপুর"]}).collect()


def test_cover_follow_up_lines(spark):
    (found,) = cover(spark, ["জেলা", "খুলনা", "সর্বমোট ভোটার", "১২০", "মোট পুরুষ", "৭০"])
    assert (found.district, found.total, found.total_male, found.gender) == ("খুলনা", 120, 70, "পুরুষ")
    assert cover(spark, []) == []


def test_cover_first_and_last(spark):
    (found,) = cover(spark, ["চূড়ান্ত ভোটার তালিকা (মহিলা)", "জেলা: খুলনা\tবিভাগ", "জেলা: যশোর", "উপজেলা/থানা: দৌলতপুর সদর", "ডাকঘর: ঘাট", "ভোটার এলাকার নাম: গ্রাম", "পোস্টকোড: ৯১০০", "পোস্টকোড: ৯২০০", "মোট পুরুষ ভোটার: ৫", "মোট মহিলা ভোটার: ৬"])
    assert (found.district, found.upazila, found.area, found.post_code, found.gender) == ("খুলনা", "দৌলতপুর", "ঘাট", "৯২০০", "মহিলা")
    assert (found.union_name, found.ward_no, found.total) == ("", "", 0)
    (found,) = cover(spark, ["ইউনিয়ন/পৌরসভা: ক  খ", "ওয়ার্ড নং: ৩", "ওয়ার্ড নম্বর", "৪"])
    assert (found.union_name, found.ward_no, found.gender) == ("ক", "৩", "পুরুষ")


#: (page, text)
ENTRY_LINES = [
    (3, "০০১. নাম: করিম হোসেন"), (3, "ভোটার নং: ১২৩৪৫"), (3, "পিতা: রহিম আলী"), (3, "মাতা: সালমা বেগম"), (3, "পেশা: কৃষক, জন্ম তারিখ: ০১/০২/১৯৮০"), (3, "ঠিকানা: নদীর ঘাট"),
    (3, "০০২. ফাতেমা"), (3, "খাতুন"), (3, "ভোটার নং ৯৮৭৬৫"), (3, "০১৬. নোটিশ"), (3, "০০৩.কামাল"), (4, "মাতা: আমেনা"),
]
ENTRIES = [("০০১", 1, 1, "করিম হোসেন", "১২৩৪৫", "রহিম আলী", "সালমা বেগম", "কৃষক,", "০১/০২/১৯৮০", "নদীর ঘাট"), ("০০২", 2, 2, "ফাতেমা খাতুন", "৯৮৭৬৫", "", "", "", "", ""), ("০১৬", 16, 1, "নোটিশ", "", "", "আমেনা", "", "", "")]


def entries(spark, lines, doc="d"):
    d = spark.createDataFrame([(doc, p, 1, i, t, 0.0, 0.0, 1.0, 1.0) for i, (p, t) in enumerate(lines)], LINE)
    found = extract.records(d).orderBy("page", "serial_num")
    return [tuple(r) for r in found.select("serial", "serial_num", "serial_on_page", "name", "number", "father", "mother", "occupation", "dob", "address").collect()]


def test_entries(spark):
    assert entries(spark, ENTRY_LINES) == ENTRIES
    assert entries(spark, ENTRY_LINES, None) == ENTRIES


def test_weak_markers(spark):
    """Those out of reach of the one before begin entries, in turn."""
    lines = [(3, "০১.ক খ")] + [(3, f"x{i}") for i in range(5)] + [(3, "০২.গ"), (3, "পিতা: ঘ")] + [(3, "y")] * 5 + [(4, "০৩.চ ছ"), (4, "পিতা: জ"), (5, "০০. শেষ"), (5, "পিতা: ঝ"), (5, "০৪.ট ঠ"), (6, "মাতা: ড")]
    assert [(r[0], r[3], r[5], r[6]) for r in entries(spark, lines)] == [("০১", "ক খ", "ঘ", ""), ("০৩", "চ ছ", "জ", ""), ("০৪", "ট ঠ", "", "ড")]


def test_long_names_and_values_are_cut(spark):
    lines = [(3, "০১. " + "ক" * 45), (3, "খ"), (3, "পিতা: " + "গ" * 90 + " মাতা নয়"), (3, "মাতা: " + "ঘ" * 90 + " পেশা: কৃষক"), (3, "পেশা: " + "চ" * 60)]
    (r,) = entries(spark, lines)
    assert (len(r[3]), r[5], len(r[6]), len(r[7])) == (45, "", 80, 50)


def test_classify_scanned(spark):
    d = spark.createDataFrame([("a", 1, "x", "F"), ("b", 1, "শেখ করিম " * 20, "Nikosh")], "doc string, page int, str string, font string")
    out = {r.doc: (r.kind, r.encoding) for r in detect.classify(d).collect()}
    assert out == {"a": ("scanned", "unknown"), "b": ("text", "unicode")}


def test_store_changes(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, s string")
    assert {r.s for r in store.without_ids(d, spark.createDataFrame([(1,)], "id int"), "id").collect()} == {"b", "c"}
    assert store.replace_by_source(d, d.limit(0), "id").count() == 3
    assert store.by_id(d, "id", 9).count() == 0


def test_commit_keeps_a_backup(spark):
    path = scratch.path(spark, "t")
    assert store.open_table(spark, path) is None
    store.commit(spark.range(3), path)
    store.commit(spark.range(5), path)
    assert store.open_table(spark, path).count() == 5 and [v.rows for v in versions.Versioned(spark, path).versions()] == [5, 3]


def test_retention(spark):
    d = spark.range(10).withColumn("t", F.col("id") % 3)
    assert sorted(r.id for r in search.retained(d, 3, "t", "id").collect()) == [2, 5, 8]


def test_session_bounds(spark):
    t = "2024-01-01 00:00:"
    d = spark.createDataFrame([(1, t + "00"), (1, t + "35"), (2, t + "00"), (2, t + "36")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = {(r.user_id, r.events) for r in activity.sessions(d).collect()}
    assert out == {(1, 2), (2, 1)}


def test_repair_with_a_limit(spark):
    d = spark.createDataFrame([(i, "করীম হোসেন", "", "", "", "খুলনা", "") for i in range(4)], "id long, name string, father string, mother string, occupation string, district string, upazila string")
    done, summary = repair.repair(d, limit=2)
    s = summary.head()
    assert (s.processed, s.modified, s.name) == (2, 2, 2) and done.count() == 4
    assert done.filter("name = 'করিম হোসেন'").count() == 2


def test_outside_failure_keeps_rows(spark):
    d = spark.createDataFrame([(1, "a")], "id int, s string")

    def fails(rows):
        raise OSError

    assert repair.outside_corrections(d, fails, ["s"]).collect() == d.collect()
    assert repair.outside_corrections(d, lambda rows: [], ["s"]).collect() == d.collect()


def test_streamed_sessions(spark):
    source, out = scratch.path(spark, "s"), scratch.path(spark, "o")
    events = spark.range(20).selectExpr("cast(id % 2 as int) user_id", "timestamp_seconds(id * 10) ts")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = activity.rate_limited(stream, "user_id", "1 minute", 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path(spark, "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.schema("user_id int, begin timestamp, end timestamp, requests long").parquet(out).count() >= 1


def test_columns_keep_no_page_together(spark):
    rows = [("d", 3, k, f"s{k}", float(x), 9.0, 5.0, 9.0) for k, x in enumerate([0, 0, 100, 100, 130, 260, 260, 300, 390])]
    rows += [(None, 3, k, "s", x, 9.0, 5.0, 9.0) for k, x in enumerate([0.0, 90.0, 90.0, 400.0, None])]
    found = layout.columns(spark.createDataFrame(rows, "doc string, page int, seq int, str string, x double, y double, width double, height double"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window ")]
    assert windows and not any("str#" in line or "seq#" in line for line in windows)
    got = {(r.doc, r.seq): r.column for r in found.collect()}
    # The middle of 100 and 130 and of 300 and 260; two equal starts make a divider where they stand.
    assert [got["d", k] for k in range(9)] == [1, 1, 1, 1, 2, 2, 2, 3, 3]
    assert [got[None, k] for k in range(5)] == [1, 2, 2, 3, 3]

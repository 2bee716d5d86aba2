"""Vectors of the text functions, derived by hand from their definitions."""

import pytest
from pyspark.sql import functions as F

from nothi.functions import bengali, decode, lookups, misc, names
from nothi.functions.similarity import jaccard, ngrams, phonetic_similarity, similarity
from nothi.operators import detect, search

RRA, DDA, NUKTA, YYA = chr(0x9DC), chr(0x9A1), chr(0x9BC), chr(0x9DF)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


def lit(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(
    "a, b",
    [("শেখ", "শখ"), ("বেগম", "বগম"), (RRA, "র"), (DDA + NUKTA, DDA), (YYA, "য"), ("য" + NUKTA, "য"), ("মোহাম্মদ", "মহমমদ"), ("ঙ", "ং"), ("  a \t b ", "a b"), ("ষসণঈঊৎ", "শশনইউত")],
)
def test_skeleton(spark, a, b):
    assert value(spark, bengali.skeleton(lit(a))) == value(spark, bengali.skeleton(lit(b)))
    assert search.key_of(a) == value(spark, bengali.search_key(lit(a)))


def test_skeleton_of_nothing(spark):
    assert value(spark, bengali.skeleton(lit(None))) == "" and value(spark, bengali.skeleton(lit(""))) == ""


@pytest.mark.parametrize("text, encoding", [("", "unicode"), ("ab", "unicode"), ("ÏÎĘĂă", "sutonny"), ("\u0080\u0081\u0082\u0083\u0084\u0085\u0086", "sutonny"), ("Avwg evsjv", "unicode"), ("abcgĘ kjnr", "bijoy"), ("শেখ ĘĘ Ă", "sutonny")])
def test_encoding(spark, text, encoding):
    assert value(spark, bengali.detect_encoding(lit(text))) == encoding


def test_signs(spark):
    e = chr(0x9C7)
    assert value(spark, bengali.reorder_pre_signs(lit("\u0002" + e + "শ"))) == "শ" + e
    assert value(spark, bengali.merge_signs(lit(e + e))) == e
    assert value(spark, bengali.mark_pre_signs(lit("শ" + e))) == "শ" + e


def test_similarity(spark):
    assert [value(spark, F.levenshtein(lit(a), lit(b))) for a, b in (("abc", "abc"), ("abc", "abd"), ("", "abc"))] == [0, 1, 3]
    assert value(spark, similarity(lit(""), lit(""))) == 1.0 and value(spark, similarity(lit("abcd"), lit("abce"))) == 0.75
    assert value(spark, phonetic_similarity(lit("শেখ"), lit("শখ"))) == 1.0


def test_ngrams(spark):
    assert sorted(value(spark, ngrams(lit("Ab ab"), 2))) == ["ab", "ba"]
    assert value(spark, ngrams(lit("a"), 2)) == [] and value(spark, ngrams(lit(None), 2)) == [] and value(spark, ngrams(lit("a b"), 3)) == []
    empty = F.array().cast("array<string>")
    assert value(spark, jaccard(empty, empty)) == 1.0 and value(spark, jaccard(ngrams(lit("ab")), empty)) == 0.0


def test_pages():
    assert [search.page_bounds("1", x)[1] for x in (0, -5, 500, None, "7")] == [100, 1, 200, 100, 7]
    assert [search.page_bounds(x)[0] for x in ("2abc", 0, -3, None, "x")] == [2, 1, 1, 1, 1]


def test_matches(spark):
    hit = lambda v, t: value(spark, F.coalesce(search.matches(lit(v), bengali.search_key(lit(v)), t), F.lit(False)))
    assert hit("শেখ করিম", "শখ") and hit("শেখ করিম", "করীম শেখ") and hit("abc", "b")
    assert not hit("", "a") and not hit("abc", "") and not hit(None, "a") and not hit("abc", "abd")


def test_multi_mode(spark):
    m = lambda v, t, mode="all": value(spark, search.multi_mode(lit(v), bengali.search_key(lit(v)), ngrams(bengali.search_key(lit(v))), t, mode))
    assert m("করিম", "করিম").method == "exact" and m("করিম", "রিম").score == 0.95 and m("করীম", "করিম").method == "phonetic"
    assert m("শেখ করিম", "করিম শেখ").method == "phonetic_multiword" and m("abcdef", "abcxef").method in ("fuzzy_ngram", "none")
    assert not m("করিম", "রিম", "exact").matched and m("", "a").method == "none"


def test_names(spark):
    assert value(spark, names.is_likely_name(lit("রহিম আলী"))) and not value(spark, names.is_likely_name(lit("abc def")))
    assert not value(spark, names.is_likely_name(lit(""))) and not value(spark, names.is_likely_name(lit("ক খ")))
    n = value(spark, names.split_name(lit(" রহিম উদ্দিন আলী ")))
    assert (n.first_name, n.surname) == ("রহিম উদ্দিন", "আলী")
    assert value(spark, names.join_name(lit("রহিম"), lit(""))) == "রহিম"


def test_quality(spark):
    d = spark.createDataFrame([(None,) * 9, ("   ",) * 9, ("করিম", "রহিম", "আমেনা", "12345", "1234567890", "d", "u", "v", "w")], "name string, father string, mother string, number string, nid string, district string, upazila string, village string, ward string")
    assert [tuple(r[0]) for r in d.select(names.quality()).collect()] == [(0, "POOR"), (20, "POOR"), (100, "EXCELLENT")]


def test_decode(spark):
    assert value(spark, decode.repair(lit("বগম"))) == "বেগম" and value(spark, decode.repair(lit("হসন"))) == "হোসেন" and value(spark, decode.repair(lit("কিমশন"))) == "কমিশন"
    assert value(spark, decode.nfc(lit("é"))) == "é"
    assert value(spark, decode.auto_convert(lit(None))).encoding == "unknown"


def test_small_conversions(spark):
    assert value(spark, misc.client_ip(lit("1.2.3.4, 5.6.7.8"))) == "1.2.3.4" and value(spark, misc.client_ip(lit(""), lit("9.9.9.9"))) == "9.9.9.9" and value(spark, misc.client_ip(lit(None))) == "127.0.0.1"
    assert value(spark, misc.search_summary({"name": lit("")})) == misc.SEARCH_ANY
    assert value(spark, bengali.ward_from_text(lit("৫ নং ওয়ার্ড"))) == "৫"


def test_lookups(spark):
    assert len(lookups.DISTRICTS) == 64 and len(lookups.DIVISIONS) == 8
    assert lookups.name_spellings()["আহমদ"] == "আহমেদ"
    assert lookups.extended([("a", "a")], {"a": "b", "c": "d"}) == [("a", "b"), ("c", "d")]
    with pytest.raises(ValueError):
        lookups.from_table(spark.range(11), 10)


@pytest.mark.parametrize("s, n", [("১২,৩৪৫", 12345), ("12abc", 12), ("abc", 0), ("-5", -5), (" 1 2 ", 12), ("", 0), (None, 0), ("০০৭.", 7)])
def test_parse_number(spark, s, n):
    assert value(spark, bengali.parse_number(lit(s))) == n


@pytest.mark.parametrize("s, a, b", [('```json\n{"a": 1, "b": "x"}\n```', 1, "x"), ('{"a": 2}', 2, None), ('```\n{"b": "y"}\n```', None, "y")])
def test_fenced_json(spark, s, a, b):
    got = value(spark, misc.unfenced_json(lit(s), "a long, b string"))
    assert (got.a, got.b) == (a, b)


@pytest.mark.parametrize("n, said", [(131072 * 123457, "15432.12 MB"), (131072 * 3 * 123457, "46296.38 MB"), (0, "0.00 MB"), (5243, "0.01 MB"), (5242, "0.00 MB"), (None, None)])
def test_size_ties(spark, n, said):
    assert value(spark, misc.size_mb(F.lit(n).cast("double"))) == said


@pytest.mark.parametrize("content, valid, error, version", [(b"%PDF-1.4\n" + b"x" * 200, True, None, "1.4"), (b"hello world" * 30, False, "no PDF header", ""), (b"", False, "too small", ""), (b"%PDF-1.7\n12345", False, "truncated", "")])
def test_integrity(spark, content, valid, error, version):
    assert tuple(value(spark, detect.integrity(F.lit(bytearray(content))))) == (valid, error, version)

"""Text queries: skeletons, digits, vowel signs, encodings, small conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from nothi.functions import bengali, decode, misc
from nothi.plans.registry import PEOPLE, cases, cases_sql, key_sql, people, query, quote, table

E, A, I_, AU, H = chr(0x9C7), chr(0x9BE), chr(0x9BF), chr(0x9D7), chr(0x9CD)
SH, KH, T, R = chr(0x9B6), chr(0x996), chr(0x9A4), chr(0x9B0)
#: (id, text): split, doubled and misplaced vowel signs.
SIGNS = [(1, SH + E + A + KH), (2, T + E + AU), (3, T + A + E), (4, T + E + E + R), (5, T + H + H + R), (6, T + A + A + A), (7, ""), (8, None), (9, "abc"), (10, SH + I_ + I_ + chr(0x9C1) * 2)]
MARKED = [(1, bengali.MARK + E + SH), (2, bengali.MARK + I_ + SH + H + R + T), (3, bengali.MARK + E), (4, T + E), (5, bengali.MARK + E + SH + bengali.MARK + I_ + T), (6, "")]
LEADING = [(1, E + SH), (2, SH + E), (3, "a" + I_ + T), (4, I_ + E), (5, "")]


@query(f"WITH {PEOPLE} SELECT id, {key_sql('name')} AS key, {key_sql('village')} AS village_key FROM people")
def search_keys(spark, sf_dir):
    """C1, C2."""
    return people(spark, sf_dir).select("id", bengali.search_key("name").alias("key"), bengali.search_key("village").alias("village_key"))


def _merged(x: str) -> str:
    for pair, one in bengali.SIGN_PAIRS:
        x = f"replace({x}, {quote(pair)}, {quote(one)})"
    return x


@query(f"SELECT id, {_merged('coalesce(s, ' + quote('') + ')')} AS s FROM ({cases_sql([(s,) for _, s in SIGNS], ['s'])})")
def complex_signs(spark, sf_dir):
    """C28."""
    return cases(spark, sf_dir, [(s,) for _, s in SIGNS], "s string").select("id", bengali.merge_signs("s").alias("s"))


_C = bengali.CONSONANT


@query(f"SELECT id, replace(regexp_replace(s, '{bengali.MARK}({bengali.PRE_SIGN})({_C}(?:{H}{_C})*)', '\\2\\1', 'g'), '{bengali.MARK}', '') AS s FROM ({cases_sql([(s,) for _, s in MARKED], ['s'])})")
def reorder_pre_signs(spark, sf_dir):
    """C24."""
    return cases(spark, sf_dir, [(s,) for _, s in MARKED], "s string").select("id", bengali.reorder_pre_signs("s").alias("s"))


@query(cases_sql([(bengali.MARK + E + SH,), (SH + E,), ("a" + bengali.MARK + I_ + T,), (bengali.MARK + I_ + bengali.MARK + E,), ("",)], ["s"]))
def mark_pre_signs(spark, sf_dir):
    """C23; SQL has no look-behind, so its rows are given."""
    return cases(spark, sf_dir, [(s,) for _, s in LEADING], "s string").select("id", bengali.mark_pre_signs("s").alias("s"))


@query("SELECT doc_id, nfc_normalize(coalesce(text, '')) AS s FROM documents")
def normal_form(spark, sf_dir):
    """C33."""
    return table(spark, sf_dir, "documents").select("doc_id", decode.nfc("text").alias("s"))


def _n(x: str, chars: str) -> str:
    return f"len(regexp_extract_all({x}, '{chars}'))"


_LATIN, _CTRL, _BENGALI = "[\\x{00C0}-\\x{024F}]", "[\\x{0080}-\\x{00BF}]", "[\\x{0980}-\\x{09FF}]"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, length(t) AS n, {_n('t', _LATIN)} AS l, {_n('t', _CTRL)} AS c, {_n('t', _BENGALI)} AS b, {_n('t', '[abcgjknprst]')} AS k FROM d)
  SELECT doc_id, CASE WHEN n < 4 THEN 'unicode' WHEN l = 0 AND c = 0 THEN 'unicode' WHEN CAST(c AS DOUBLE) / n > CAST(0.05 AS DOUBLE) THEN 'sutonny' WHEN b > 0 AND l > 0 THEN 'sutonny'
    WHEN b = 0 AND k > n * CAST(0.3 AS DOUBLE) THEN 'bijoy' WHEN l > 0 THEN 'sutonny' ELSE 'unicode' END AS encoding, round(CASE WHEN n = 0 THEN 0 ELSE CAST(l AS DOUBLE) / n END, 9) AS legacy FROM c""")
def encoding_detect(spark, sf_dir):
    """C25, C26."""
    return table(spark, sf_dir, "documents").select("doc_id", bengali.detect_encoding("text").alias("encoding"), F.round(bengali.legacy_share("text"), 9).alias("legacy"))


@query("SELECT doc_id, md5(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[^\\x{0980}-\\x{09FF}\\x{0964}-\\x{0965}0-9 \\t/.\\-,():;]', '', 'g')) AS h FROM documents")
def keep_bengali(spark, sf_dir):
    """C27, as the checksum of what stays."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(bengali.keep_bengali("text").cast("binary")).alias("h"))


@query(f"SELECT l_orderkey, l_linenumber, translate(CAST(l_orderkey AS VARCHAR), '0123456789', {quote(bengali.DIGITS_BN)}) AS shown, l_orderkey AS back FROM lineitem")
def digits_bn(spark, sf_dir):
    """Bengali digits and back."""
    shown = bengali.to_bengali_digits(F.col("l_orderkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown"), bengali.parse_number(shown).alias("back"))


#: Numbers in both kinds of digits, with commas, spaces, signs and words around them.
_WRITTEN = """CASE o_orderkey % 7 WHEN 0 THEN translate(concat(CAST(CAST(floor(o_totalprice) AS BIGINT) // 1000 AS VARCHAR), ',', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0')), '0123456789', '০১২৩৪৫৬৭৮৯')
  WHEN 1 THEN concat(CAST(o_orderkey AS VARCHAR), 'abc') WHEN 2 THEN concat('abc', CAST(o_orderkey AS VARCHAR)) WHEN 3 THEN concat('-', CAST(o_custkey AS VARCHAR)) WHEN 4 THEN concat(' 1 ', CAST(o_custkey AS VARCHAR), ' ') WHEN 5 THEN concat('০০', translate(CAST(o_custkey AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯'), '.') END"""


@query(f"SELECT o_orderkey, coalesce(TRY_CAST(nullif(regexp_extract(translate(regexp_replace({_WRITTEN}, '[, ]', '', 'g'), '০১২৩৪৫৬৭৮৯', '0123456789'), '^[+-]?[0-9]{{1,18}}'), '') AS BIGINT), 0) AS n FROM orders")
def parse_number(spark, sf_dir):
    """C34."""
    written = _WRITTEN.replace("//", "div").replace("VARCHAR", "STRING")
    return table(spark, sf_dir, "orders").select("o_orderkey", bengali.parse_number(F.expr(written)).alias("n"))


GLYPHS = [("Avwg", "অ" + A + "মি"), ("†kL", "শেখ"), ("wcZv", "পিতা"), ("123", "১২৩"), ("", "")]


@query(cases_sql([(t,) for _, t in GLYPHS], ["s"]))
def glyph_convert(spark, sf_dir):
    """Glyphs to Unicode."""
    return cases(spark, sf_dir, [(s,) for s, _ in GLYPHS], "s string").select("id", decode.convert("s").alias("s"))


AUTO = [("", None, "", "unknown"), ("শেখ", None, "শেখ", "unicode"), ("কিমশন", None, "কমিশন", "unicode"), ("Avwg", "bijoy", "অ" + A + "মি", "bijoy"), ("Avwg", "other", "অ" + A + "মি", "other"), ("†kL ‡gvt", None, "†kL ‡gvt", "unicode")]


@query(cases_sql([(t, e) for _, _, t, e in AUTO], ["s", "encoding"]))
def auto_convert(spark, sf_dir):
    """A hint beats detection, an unknown one takes the first legacy table; legacy text without telling letters is not detected."""
    return cases(spark, sf_dir, [(s, h) for s, h, _, _ in AUTO], "s string, hint string").withColumn("r", decode.auto_convert("s", F.col("hint"))).select("id", F.col("r.text").alias("s"), "r.encoding")


REPAIRED = [("বগম", False, "বেগম"), ("বগমপুর", False, "বগমপুর"), ("বগমপুর", True, "বেগমপুর"), ("বগম বগম  হসন", False, "বেগম বেগম হোসেন"), ("  কিমশন ", False, "কমিশন")]


@query(cases_sql([(t,) for _, _, t in REPAIRED], ["s"]))
def repair_text(spark, sf_dir):
    """Whole words, and inside words when strict."""
    d = cases(spark, sf_dir, [(s, k) for s, k, _ in REPAIRED], "s string, strict boolean")
    return d.select("id", F.when(F.col("strict"), decode.repair("s", strict=True)).otherwise(decode.repair("s")).alias("s"))


PLACED = [("িপতা: রহিম", "পিতা: রহিম"), (I_ + T + R, T + I_ + R), ("a " + E + SH, "a " + SH + E), ("", "")]


@query(cases_sql([(t,) for _, t in PLACED], ["s"]))
def place_pre_signs(spark, sf_dir):
    """C29."""
    return cases(spark, sf_dir, [(s,) for s, _ in PLACED], "s string").select("id", decode.place_pre_signs("s").alias("s"))


PREFIXED = [("নাম: রহিম", "রহিম"), ("নামঃ- করিম ", "ঃ- করিম"), ("\u200bনাম কামাল", "কামাল"), (": . সালমা", "সালমা"), ("", ""), (None, "")]


@query(cases_sql([(t,) for _, t in PREFIXED], ["s"]))
def name_prefix(spark, sf_dir):
    """X5."""
    return cases(spark, sf_dir, [(s,) for s, _ in PREFIXED], "s string").select("id", bengali.clean_name_prefix("s").alias("s"))


@query(f"""SELECT o_orderkey, translate(CAST(day(o_orderdate) AS VARCHAR) || '/' || CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR), '0123456789', {quote(bengali.DIGITS_BN)}) AS dob FROM orders""")
def date_tokens(spark, sf_dir):
    """The date inside a line of text."""
    said = F.concat_ws("/", F.dayofmonth("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.year("o_orderdate").cast("string"))
    line = F.concat(F.lit("পেশা: কৃষক, জন্ম তারিখ: "), bengali.to_bengali_digits(said), F.lit(" "))
    return table(spark, sf_dir, "orders").select("o_orderkey", bengali.date_token(line).alias("dob"))


@query("""SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_type) > 35 THEN left(p_name || ' ' || p_type, 35) || '...' ELSE p_name || ' ' || p_type END AS short, regexp_replace(p_name, '\\s+', '_', 'g') AS file, printf('%.2f', p_partkey * 123457.0::DOUBLE / 1048576) || ' MB' AS size FROM part""")
def display_texts(spark, sf_dir):
    """C40, C41."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", misc.ellipsis(F.concat_ws(" ", "p_name", "p_type")).alias("short"), misc.file_safe("p_name").alias("file"), misc.size_mb(F.col("p_partkey") * 123457.0).alias("size"))


@query("SELECT doc_id, coalesce(text, '') AS s FROM documents")
def latin1_names(spark, sf_dir):
    """Text that was read with the wrong character set, put right."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    wrong = F.decode(F.encode("t", "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", misc.latin1_to_utf8(wrong).alias("s"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE CAST(p_size AS BIGINT) END AS a, CASE p_partkey % 4 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE p_name END AS b FROM part")
def fenced_json(spark, sf_dir):
    """C42."""
    k, both = F.col("p_partkey") % 4, F.to_json(F.struct(F.col("p_size").alias("a"), F.col("p_name").alias("b")))
    fence = lambda kind, c: F.concat(F.lit(f"```{kind}\n"), c, F.lit("\n```"))
    said = F.when(k == 0, fence("json", both)).when(k == 1, F.to_json(F.struct(F.col("p_size").alias("a")))).when(k == 2, fence("", F.to_json(F.struct(F.col("p_name").alias("b"))))).otherwise(fence("json", F.lit("none")))
    d = table(spark, sf_dir, "part").withColumn("j", misc.unfenced_json(said, "a long, b string"))
    return d.select("p_partkey", F.coalesce("j.a", F.lit(0)).alias("a"), "j.b")


@query(f"""WITH {PEOPLE} SELECT id, coalesce(nullif(array_to_string(list_filter([CASE WHEN name <> '' THEN 'নাম: ' || name END, CASE WHEN father <> '' THEN 'পিতা: ' || father END, CASE WHEN village <> '' THEN 'গ্রাম/মহল্লা: ' || village END], lambda x: x IS NOT NULL), ', '), ''), {quote(misc.SEARCH_ANY)}) AS summary,
  CASE WHEN village <> '' THEN 'VILLAGE_SEARCH' ELSE 'NAME_SEARCH' END AS method FROM people""")
def log_summary_text(spark, sf_dir):
    """C38."""
    return people(spark, sf_dir).select("id", misc.search_summary({"name": "name", "father": "father", "village": "village"}).alias("summary"), misc.search_method("village").alias("method"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '127.0.0.1' ELSE '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.1' END AS ip FROM events")
def client_ip(spark, sf_dir):
    """C39."""
    head = F.concat(F.lit(" 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1 , 192.0.2.1"))
    return table(spark, sf_dir, "events").select("event_id", misc.client_ip(F.when(F.col("event_id") % 3 != 0, head)).alias("ip"))

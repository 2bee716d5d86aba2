"""Layout and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nothi.functions import bengali, lookups, misc
from nothi.operators import detect, extract, layout
from nothi.plans import register
from nothi.plans.registry import PEOPLE, people, query, quote, table
from nothi.plans.repair import records_from_items

_ITEMS = "SELECT CAST(l_orderkey % 97 AS VARCHAR) AS doc, 3 + CAST(l_orderkey % 5 AS INTEGER) AS page, l_orderkey * 10 + l_linenumber AS seq, l_returnflag || l_linenumber AS str, CAST((l_partkey * 7) % 600 AS DOUBLE) AS x, CAST(800 - (l_suppkey % 60) * 10 AS DOUBLE) AS y, CAST(l_quantity * 2 AS DOUBLE) AS width, CAST(9 AS DOUBLE) AS height FROM lineitem"


def items(spark, sf_dir):
    """Positioned items made from line items: two million distinct places at most."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") % 97).cast("string").alias("doc"),
        (F.lit(3) + (F.col("l_orderkey") % 5)).cast("int").alias("page"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("str"),
        ((F.col("l_partkey") * 7) % 600).cast("double").alias("x"),
        (F.lit(800) - (F.col("l_suppkey") % 60) * 10).cast("double").alias("y"),
        (F.col("l_quantity") * 2).alias("width"),
        F.lit(9.0).alias("height"),
    )


def _split(name: str, low: float, high: float) -> str:
    at = f"SELECT doc, page, x, seq FROM i JOIN s USING (doc, page) WHERE width < rng * CAST(0.4 AS DOUBLE) AND x >= lo + rng * CAST({low} AS DOUBLE) AND x <= lo + rng * CAST({high} AS DOUBLE)"
    return f"{name} AS (SELECT doc, page, mid AS {name} FROM (SELECT doc, page, (x + nx) / 2 AS mid, row_number() OVER (PARTITION BY doc, page ORDER BY nx - x DESC, x) AS n FROM (SELECT *, lead(x) OVER (PARTITION BY doc, page ORDER BY x, seq) AS nx FROM ({at})) WHERE nx IS NOT NULL) WHERE n = 1)"


@query(f"""WITH i AS ({_ITEMS}), s AS (SELECT doc, page, min(x) AS lo, max(x) - min(x) AS rng FROM i GROUP BY ALL), {_split('b1', 0.20, 0.45)}, {_split('b2', 0.55, 0.80)},
  c AS (SELECT i.doc, i.page, i.seq, CASE WHEN rng < 150 THEN 1 WHEN x < coalesce(b1, lo + rng * CAST(0.33 AS DOUBLE)) THEN 1 WHEN x < coalesce(b2, lo + rng * CAST(0.66 AS DOUBLE)) THEN 2 ELSE 3 END AS c
    FROM i JOIN s USING (doc, page) LEFT JOIN b1 USING (doc, page) LEFT JOIN b2 USING (doc, page))
  SELECT doc, page, seq, CAST(dense_rank() OVER (PARTITION BY doc, page ORDER BY c) AS INTEGER) AS "column" FROM c""")
def column_clusters(spark, sf_dir):
    """X1."""
    return layout.columns(items(spark, sf_dir)).select("doc", "page", "seq", "column")


@query(f"""WITH i AS ({_ITEMS}), g AS (SELECT *, dense_rank() OVER (PARTITION BY doc, page ORDER BY y DESC) AS line FROM i)
  SELECT doc, page, CAST(line AS INTEGER) AS line, trim(regexp_replace(string_agg(str, ' ' ORDER BY x, seq, str), '\\s{{3,}}', chr(9), 'g')) AS text, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM g GROUP BY doc, page, line""")
def line_bbox(spark, sf_dir):
    """X2, A6, A7 where lines are ten apart."""
    return layout.lines(items(spark, sf_dir), ["doc", "page"])


_HEIGHT = "100 - CAST((l_suppkey * 3 + l_linenumber * 7) % 23 AS DOUBLE) / 2"


@query(f"""WITH RECURSIVE i AS (SELECT l_orderkey AS doc, l_linenumber AS seq, {_HEIGHT} AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_HEIGHT} DESC, l_linenumber) AS n FROM lineitem),
  r AS (SELECT doc, seq, n, y AS anchor, 1 AS line FROM i WHERE n = 1 UNION ALL
    SELECT i.doc, i.seq, i.n, CASE WHEN abs(i.y - r.anchor) > 4 THEN i.y ELSE r.anchor END, CASE WHEN abs(i.y - r.anchor) > 4 THEN r.line + 1 ELSE r.line END FROM r JOIN i ON i.doc = r.doc AND i.n = r.n + 1)
  SELECT doc, seq, CAST(line AS BIGINT) AS line FROM r""")
def line_grouping(spark, sf_dir):
    """The distance to the line's first item counts, and not that to the item before."""
    li = table(spark, sf_dir, "lineitem")
    d = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.lit("s").alias("str"), F.col("l_linenumber").cast("double").alias("x"), (100 - ((F.col("l_suppkey") * 3 + F.col("l_linenumber") * 7) % 23).cast("double") / 2).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    return layout.line_groups(d, ["doc"]).select("doc", "seq", F.col("line").cast("long").alias("line"))


@query(f"WITH i AS ({_ITEMS}) SELECT page, count(*) AS n FROM i WHERE page >= 4 AND page NOT IN (5) AND length(str) > 0 GROUP BY page")
def page_filter(spark, sf_dir):
    """F12, F13."""
    return layout.usable_items(items(spark, sf_dir), first_page=4, skipped=(5,)).groupBy("page").agg(F.count("*").alias("n"))


_COVER = "doc, district, upazila, area, area_no, total, total_male, total_female, gender, published, post_code"
_ENTRY = "doc, serial, serial_num, name, number, father, mother, occupation, dob, address"
_KNOWN = {"খুলনা": ["দৌলতপুর"]}


@query(f"WITH {register.covers_sql(_KNOWN)} SELECT {_COVER} FROM covers")
def cover_meta(spark, sf_dir):
    """The fields of every cover."""
    return extract.cover_meta(register.cover_lines(spark, sf_dir), _KNOWN).select(*_COVER.split(", "))


_VALID = "length(name) > 1 AND (number <> '' OR father <> '' OR mother <> '')"


@query(f"WITH {register.ENTRIES} SELECT {_ENTRY}, (serial_num - 1) % 15 + 1 AS serial_on_page FROM entries WHERE {_VALID}")
def record_extract(spark, sf_dir):
    """Entries, wrapped names, and markers without a space, which end no entry."""
    found = extract.records(register.entry_lines(spark, sf_dir))
    long = lambda c: F.col(c).cast("long").alias(c)
    return found.select(long("doc"), "serial", long("serial_num"), *_ENTRY.split(", ")[3:], long("serial_on_page"))


@query(f"""WITH {register.ENTRIES}, {register.covers_sql(lookups.UPAZILAS)} SELECT e.doc, e.name, e.number, c.district, c.upazila, coalesce(c.area, '') AS village,
  coalesce(nullif(e.address, ''), CASE WHEN c.doc IS NULL THEN '' ELSE concat_ws(', ', c.area, c.upazila, c.district) END) AS address, coalesce(c.gender, 'পুরুষ') AS gender FROM (SELECT * FROM entries WHERE {_VALID}) e LEFT JOIN covers c ON c.doc = e.doc""")
def document_pipeline(spark, sf_dir):
    """Positioned items of whole registers to records with their cover's fields."""
    return records_from_items(register.items(spark, sf_dir)).select(F.col("doc").cast("long").alias("doc"), "name", "number", "district", "upazila", "village", "address", "gender")


@query(f"""WITH {PEOPLE}, a AS (SELECT id, k, village, area || ' , ' || upazila || '|' || district AS address FROM people), p AS (SELECT *, list_filter(list_transform(string_split_regex(coalesce(address, ''), '[,|]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM a)
  SELECT id, coalesce(nullif(village, ''), CASE WHEN len(parts) >= 3 THEN parts[1] END, '') AS village, coalesce(CASE WHEN len(parts) >= 3 THEN parts[-2] END, '') AS upazila, coalesce(CASE WHEN len(parts) >= 3 THEN parts[-1] END, '') AS district FROM p""")
def address_parts(spark, sf_dir):
    """X9."""
    p = people(spark, sf_dir).withColumn("address", F.concat("area", F.lit(" , "), "upazila", F.lit("|"), "district"))
    return p.withColumn("a", misc.address_parts("address", "village", F.lit(""), F.lit(""))).select("id", "a.village", "a.upazila", "a.district")


_WARD = "ও" + chr(0x9AF) + chr(0x9BC) + "ার্ড"


@query(f"""WITH {PEOPLE} SELECT id, regexp_extract(CAST(k % 30 AS VARCHAR) || ' নং {_WARD} ' || village, '([0-9]+)\\s*(?:নং)?\\s*{_WARD}', 1) AS ward, CAST((k - 1) % 15 + 1 AS INTEGER) AS place FROM people""")
def ward_from_text(spark, sf_dir):
    """X10, and the place of a serial number on its page."""
    said = F.concat((F.col("k") % 30).cast("string"), F.lit(f" নং {_WARD} "), "village")
    return people(spark, sf_dir).select("id", bengali.ward_from_text(said).alias("ward"), misc.serial_on_page(F.col("k")).alias("place"))


_FILE = """CASE o_orderkey % 5 WHEN 0 THEN concat('%PDF-1.', CAST(o_orderkey % 8 AS VARCHAR), repeat(' x', 200)) WHEN 1 THEN repeat(o_orderpriority, 40) WHEN 2 THEN '%PDF' WHEN 3 THEN concat('%PDF-1.7', CAST(o_orderkey AS VARCHAR), ' ', o_orderpriority) END"""


@query(f"""WITH f AS (SELECT o_orderkey, {_FILE} AS t FROM orders), e AS (SELECT *, CASE WHEN length(coalesce(t, '')) < 10 THEN 'too small' WHEN NOT starts_with(t, '%PDF-') THEN 'no PDF header' WHEN length(t) < 200 THEN 'truncated' END AS error FROM f)
  SELECT o_orderkey, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN regexp_extract(t, '^%PDF-([0-9.]+)', 1) ELSE '' END AS version FROM e""")
def pdf_integrity(spark, sf_dir):
    """S28."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_FILE.replace("VARCHAR", "STRING")).cast("binary").alias("content"))
    return d.withColumn("r", detect.integrity("content")).select("o_orderkey", "r.valid", "r.error", "r.version")


@query("SELECT p_partkey, p_name || '.PDF' AS name FROM part WHERE p_size * 2000000 <= 52428800 AND p_partkey % 3 <> 0")
def upload_filter(spark, sf_dir):
    """PDFs by type or name, not over 50 MB."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ".txt").otherwise(".PDF")).alias("name"), F.lit("text/plain").alias("mime"), (F.col("p_size").cast("long") * 2000000).alias("length"))
    return detect.accepted_uploads(p).select("p_partkey", "name")


_PROFILE = "sum(length(text)) AS chars, sum(len(regexp_extract_all(text, '[\\x{0980}-\\x{09FF}]'))) AS bengali, sum(len(regexp_extract_all(text, '[\\x{00C0}-\\x{024F}]'))) AS latin_extended, sum(len(regexp_extract_all(text, '[\\x{0080}-\\x{00BF}]'))) AS control"


@query(f"SELECT lang, CAST(chars AS BIGINT) AS chars, CAST(bengali AS BIGINT) AS bengali, CAST(latin_extended AS BIGINT) AS latin_extended, CAST(control AS BIGINT) AS control FROM (SELECT lang, {_PROFILE} FROM documents GROUP BY lang)")
def char_class_profile(spark, sf_dir):
    """A8, A14."""
    return detect.profile(table(spark, sf_dir, "documents"), ["lang"], "text")


_FONTS = ["SutonnyMJ", "Nikosh-Bold", "Arial", "BijoyX"]


@query(f"""WITH i AS (SELECT doc_id, text, ([{', '.join(map(quote, _FONTS))}])[CAST(doc_id % 4 AS INTEGER) + 1] AS font FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, font, {_PROFILE} FROM i GROUP BY doc_id, font),
  r AS (SELECT doc_id, font, chars, chars > 10 AS full_page, CAST(latin_extended AS DOUBLE) / chars AS l, CAST(control AS DOUBLE) / chars AS c, CAST(bengali AS DOUBLE) / chars AS b FROM p)
  SELECT doc_id, CASE WHEN (CASE WHEN full_page THEN chars ELSE 0 END) < 30 THEN 'scanned' WHEN doc_id % 4 IN (0, 3) THEN 'legacy_font' WHEN doc_id % 4 = 1 THEN 'text' WHEN l > CAST(0.03 AS DOUBLE) OR c > CAST(0.02 AS DOUBLE) THEN 'legacy_font' WHEN b > CAST(0.1 AS DOUBLE) THEN 'text' ELSE 'legacy_font' END AS kind,
    CASE WHEN (CASE WHEN full_page THEN chars ELSE 0 END) < 30 THEN 'unknown' WHEN doc_id % 4 = 3 THEN 'bijoy' WHEN doc_id % 4 = 1 THEN 'unicode' WHEN doc_id % 4 = 0 THEN 'sutonny' WHEN l <= CAST(0.03 AS DOUBLE) AND c <= CAST(0.02 AS DOUBLE) AND b > CAST(0.1 AS DOUBLE) THEN 'unicode' ELSE 'sutonny' END AS encoding,
    round(CASE WHEN (CASE WHEN full_page THEN chars ELSE 0 END) < 30 THEN CAST(0.9 AS DOUBLE) WHEN doc_id % 4 IN (0, 3) THEN CAST(0.98 AS DOUBLE) WHEN doc_id % 4 = 1 THEN CAST(0.95 AS DOUBLE) WHEN l > CAST(0.03 AS DOUBLE) OR c > CAST(0.02 AS DOUBLE) THEN least(CAST(0.95 AS DOUBLE), 0.5 + l * 3 + c * 5) WHEN b > CAST(0.3 AS DOUBLE) THEN CAST(0.85 AS DOUBLE) WHEN b > CAST(0.1 AS DOUBLE) THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END, 6) AS confidence,
    font AS fonts FROM r""")
def pdf_classify(spark, sf_dir):
    """S29, S30, A9."""
    d = table(spark, sf_dir, "documents")
    i = d.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.col("text").alias("str"), F.element_at(F.array(*map(F.lit, _FONTS)), ((F.col("doc_id") % 4) + 1).cast("int")).alias("font"))
    return detect.classify(i).select(F.col("doc").alias("doc_id"), "kind", "encoding", F.round("confidence", 6).alias("confidence"), F.array_join("fonts", ",").alias("fonts"))


@query("SELECT p_partkey, upper(hex(p_name)) AS h FROM part")
def hex_dump(spark, sf_dir):
    """Code units of a text; ASCII ones differ from their bytes by a zero byte each."""
    d = detect.hex_dump(table(spark, sf_dir, "part").withColumnRenamed("p_name", "str"), n=200)
    return d.select("p_partkey", F.regexp_replace("hex", "00(..)", "$1").alias("h"))

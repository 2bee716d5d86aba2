"""Queries over tables of records, documents and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from nothi.operators import search
from nothi.plans import dashboard
from nothi.plans.registry import PEOPLE, people, query, table
from nothi.sources import backends, documents, scratch, store

_LOGS = "SELECT event_id AS id, ts AS date_time, event_type AS query, user_id FROM events"


def _logs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("date_time"), F.col("event_type").alias("query"), "user_id")


@query("""SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE '' END, ''), nullif(c_mktsegment, ''), '—') AS segment, coalesce(nullif(CASE WHEN c_custkey % 5 <> 0 THEN c_name END, ''), '—') AS name
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def parent_fallback(spark, sf_dir):
    """The child's value, else its parent's, else a dash."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("segment"), F.lit(None).cast("string").alias("name"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("c_name"))
    return store.with_parent(o, c, ("o_custkey", "c_custkey"), {"segment": "c_mktsegment", "name": "c_name"}).select("o_orderkey", "segment", "name")


@query("""WITH n AS (SELECT l_orderkey, CAST(99 AS INTEGER) AS l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY l_orderkey)
  SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n""")
def upsert_by_source(spark, sf_dir):
    """All rows of a source replaced."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = li.filter("l_orderkey % 7 = 0").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("l_quantity")).select("l_orderkey", F.lit(99).alias("l_linenumber"), "l_quantity")
    return store.replace_by_source(li, new, "l_orderkey")


@query("SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def cascade_delete(spark, sf_dir):
    """Parents and their children go."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a, b = store.cascade_delete(o, li, o.filter("o_custkey % 10 = 0"), "o_orderkey", "l_orderkey")
    return a.agg(F.lit("orders").alias("t"), F.count("*").alias("n")).union(b.agg(F.lit("lineitem").alias("t"), F.count("*").alias("n")))


@query("SELECT count(*) AS removed FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def removed_by_source(spark, sf_dir):
    """How many rows go with their source."""
    return store.removed_count(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def delete_by_ids(spark, sf_dir):
    """Anti join with a list of ids."""
    return store.without_ids(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_totalprice > 150000"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(f"SELECT id, query FROM ({_LOGS}) ORDER BY date_time DESC, id DESC LIMIT 1000")
def log_retention(spark, sf_dir):
    """The newest thousand stay."""
    return search.retained(_logs(spark, sf_dir), 1000, "date_time", "id").select("id", "query")


@query(f"SELECT id, query FROM ({_LOGS}) ORDER BY date_time DESC, id DESC LIMIT 100")
def latest_logs(spark, sf_dir):
    """S32, O3, O4."""
    return search.newest(_logs(spark, sf_dir), 100, "date_time", "id").select("id", "query")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def newest_documents(spark, sf_dir):
    """S19, O2."""
    return search.newest(table(spark, sf_dir, "orders"), 500, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    """S20."""
    return store.by_id(table(spark, sf_dir, "customer"), "c_custkey", 42)


@query("SELECT c_custkey, CASE WHEN c_custkey = 42 THEN CAST(1 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer")
def update_by_id(spark, sf_dir):
    """S22."""
    return store.set_by_id(table(spark, sf_dir, "customer"), "c_custkey", 42, "c_acctbal", 1.0).select("c_custkey", "c_acctbal")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 8 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer""")
def update_with_fallback(spark, sf_dir):
    """New values where they are filled."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 4 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 8 == 0, F.col("c_acctbal") + 1).otherwise(0.0).alias("c_acctbal"))
    return store.update_with_fallback(c, new, "c_custkey", ["c_name", "c_acctbal"])


@query(f"""WITH {PEOPLE} SELECT id, name AS name_bn, nullif(coalesce(father, ''), '') AS father_name, nullif(village, '') AS village, CAST(k AS VARCHAR) AS serial_no, nullif(CAST(k % 3 AS VARCHAR), '0') AS page_number, CASE WHEN k % 2 = 0 THEN 'x' ELSE 'সক্রিয়' END AS status FROM people""")
def record_mapper(spark, sf_dir):
    """Application rows to table rows, blanks and zeros null, defaults filled."""
    p = people(spark, sf_dir).select("id", F.col("name").alias("nameBn"), F.col("father").alias("fatherName"), "village", F.col("k").alias("serialNo"), F.nullif((F.col("k") % 3).cast("int"), F.lit(0)).alias("pdfPageNumber"), F.when(F.col("k") % 2 == 0, "x").otherwise("").alias("status"))
    return store.to_columns(p, store.RECORD_COLUMNS).select("id", "name_bn", "father_name", "village", "serial_no", "page_number", "status")


@query(f"""WITH {PEOPLE} SELECT id, name AS "fileName", coalesce(village, '') AS village, id || '.pdf' AS "safeFileName" FROM people""")
def upload_mapper(spark, sf_dir):
    """Table rows to application rows."""
    p = people(spark, sf_dir).select("id", F.col("name").alias("file_name"), F.col("village").alias("voter_area"))
    return store.uploads_from_columns(p).select("id", "fileName", F.col("voterArea").alias("village"), "safeFileName")


@query("""SELECT event_id + 1 AS id, event_type AS query, CAST(user_id AS VARCHAR) || 'ms' AS "responseTime" FROM events""")
def log_mapper(spark, sf_dir):
    """A log row to the table and back."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("id"), F.col("event_type").alias("query"), F.concat(F.col("user_id").cast("string"), F.lit("ms")).alias("responseTime"))
    return store.from_columns(store.to_columns(e, store.LOG_COLUMNS, {}), store.LOG_COLUMNS).select("id", "query", "responseTime")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_scan(spark, sf_dir):
    """A JSON document with three arrays, scanned as tables."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    one = n.groupBy().agg(F.collect_list(F.struct("id", "name")).alias("voters"))
    path = scratch.path(spark, "db")
    one.withColumns({"pdfs": F.array().cast("array<struct<id:string>>"), "searchLogs": F.array().cast("array<struct<id:string>>")}).write.json(path)
    schema = "voters array<struct<id:int,name:string>>, pdfs array<struct<id:string>>, searchLogs array<struct<id:string>>"
    return store.scan_json(spark, path, schema)["voters"]


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, upper(r_name) FROM region")
def commit_and_append(spark, sf_dir):
    """A table replaced, appended to, and read again."""
    path, r = scratch.path(spark, "regions"), table(spark, sf_dir, "region")
    store.commit(r.limit(0), path)
    store.commit(r, path)
    store.append(r.select((F.col("r_regionkey") + 10).cast("int").alias("r_regionkey"), F.upper("r_name").alias("r_name")), path, rows_a_file=store.BATCH)
    return store.open_table(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS place, n_name FROM nation UNION ALL SELECT -1 - CAST(r_regionkey AS BIGINT), r_name FROM region")
def prepend(spark, sf_dir):
    """New rows before all others."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("place"), "n_name")
    return store.prepend(n, table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("place"), F.col("r_name").alias("n_name")), "place")


@query("SELECT CASE event_type WHEN 'click' THEN 'WARN' ELSE 'ERROR' END AS level, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def log_lines(spark, sf_dir):
    """JSON lines from a level upward, read back."""
    path = scratch.path(spark, "log")
    level = F.when(F.col("event_type") == "view", "INFO").when(F.col("event_type") == "click", "WARN").otherwise("ERROR")
    store.write_log_lines(table(spark, sf_dir, "events").select(level.alias("level"), "event_id"), path, "WARN")
    return spark.read.schema("level string, event_id long").json(path).groupBy("level").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM orders) AS documents, (SELECT CAST(sum(CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey ELSE 0 END) AS BIGINT) FROM orders) AS records, (SELECT count(*) FROM events) AS searches")
def dashboard_totals(spark, sf_dir):
    """A2, A3, A4, R3."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("voter_count"))
    return dashboard.totals(o, table(spark, sf_dir, "events"))


@query("SELECT o_orderkey AS id, o_orderpriority || ' › ' || o_orderstatus || ' › ' AS place, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey * 2 END AS shown FROM orders")
def area_cards(spark, sf_dir):
    """A5: the total that the gender type calls for."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("district"), F.col("o_orderstatus").alias("upazila"), F.lit("").alias("union_name"), F.lit("").alias("voter_area"), (F.col("o_custkey") * 2).alias("total_voters"), F.col("o_custkey").alias("total_female_voters"), F.when(F.col("o_orderkey") % 2 == 0, search.GENDERS["female"]).otherwise(search.GENDERS["male"]).alias("gender_type"))
    return dashboard.area_cards(o).select("id", "place", "shown")


@query(f"WITH {PEOPLE} SELECT id, name, coalesce(village, '') AS village, upazila, district, '' AS ward, gender FROM people")
def result_projection(spark, sf_dir):
    """results as shown."""
    p = people(spark, sf_dir).withColumns({"address": F.lit(None).cast("string"), "ward": F.lit("")})
    return dashboard.shown_records(p)


@query(f"SELECT id, strftime(date_time, '%Y-%m-%d %H:%M:%S') AS at, query, 'Success' AS status FROM ({_LOGS}) ORDER BY date_time DESC, id LIMIT 50")
def log_projection(spark, sf_dir):
    """The latest searches as shown."""
    return dashboard.shown_logs(_logs(spark, sf_dir).withColumn("status", F.lit("")))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 3")
def backend_tables(spark, sf_dir):
    """The same calls for a folder and a database; the folder is what there is without one."""
    n, backend = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), backends.choose(scratch.path(spark, "tables"))
    backend.replace(n, "nation")
    backend.replace(store.without_ids(backend.read(spark, "nation"), n.filter("n_nationkey < 5"), "n_nationkey"), "nation")
    backend.append(n.filter("n_nationkey < 3").select((F.col("n_nationkey") + 100).cast("int").alias("n_nationkey"), "n_name"), "nation")
    return backend.read(spark, "nation")


def _pages(content: bytes) -> list[list[tuple]]:
    """A reader for tests: pages parted by form feeds, an item per line."""
    if content.startswith(b"bad"):
        raise ValueError("unreadable")
    return [[(line, 10.0, 700.0 - 20 * i, 100.0, 10.0, "F") for i, line in enumerate(page.split("\n"))] for page in content.decode().split("\f")]


def _blobs(spark, sf_dir):
    """A file for each order: pages of lines, some unreadable, some empty."""
    k = F.col("o_orderkey")
    page = F.array_join(F.transform(F.sequence(F.lit(1), k % 4 + 1), lambda i: F.concat("o_orderpriority", F.lit(" "), i.cast("string"))), "\n")
    pages = F.array_join(F.array_repeat(page, (k % 3 + 1).cast("int")), "\f")
    text = F.when(k % 7 == 3, F.concat(F.lit("bad"), pages)).when(k % 11 == 0, "").otherwise(pages)
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("doc"), text.cast("binary").alias("content"))


_KIND = "CASE WHEN o_orderkey % 7 = 3 THEN 'bad' WHEN o_orderkey % 11 = 0 THEN 'empty' ELSE 'pages' END"


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS doc, CASE {_KIND} WHEN 'bad' THEN 0 WHEN 'empty' THEN 1 ELSE (o_orderkey % 4 + 1) * CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 1 END END AS records,
  CASE WHEN {_KIND} = 'bad' THEN 'ValueError: unreadable' END AS error FROM orders""")
def document_status(spark, sf_dir):
    """Items through a reader, without the second pages; a document that fails stays, without records."""
    blobs = _blobs(spark, sf_dir)
    items = documents.read_items(blobs, _pages)
    return documents.parse_status(blobs, items, items.filter("error is null"))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS doc, CASE WHEN {_KIND} <> 'pages' THEN '' ELSE array_to_string([o_orderpriority || ' ' || i FOR i IN range(1, o_orderkey % 4 + 2)], ' ') END AS text FROM orders""")
def recognised_text(spark, sf_dir):
    """Text of the first page of scans through a recogniser, empty where it fails."""
    return documents.recognised_text(_blobs(spark, sf_dir), lambda b: [" ".join(i[0] for i in _pages(b)[0])], 1)

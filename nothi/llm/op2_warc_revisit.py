"""WARC archives with revisit records for payloads that were already kept.

Headers (digest, page_id, url) are shuffled by payload digest and summed up before that to the first
page of each digest; a digest that occurs once needs no more. Pages are then joined to those first
pages on the digest, and every task writes its rows as gzip members with fresh headers: a ``response``
with the payload, or a ``revisit`` that names the response and carries no payload.
Digests with more than a thousandth of all rows, at most 1000 by that rule, are broadcast; the rows that
met them, and those that refer to none (small payloads, null page_ids), get keys of their own for the shuffled join with the rest, so no task gets a hot digest.
A record's id is made of its page_id, payload digest and url, so different rows have different ids, and a task that is run again gives the same; its date is
that of the writing.

Null html is an empty payload. Payloads under 100 bytes are always responses. Rows with a null
page_id are responses and never referred to; of rows that repeat a page_id and payload each with the smallest
page_id is a response (equal rows are one record, written as often). Very long html is held by one task a record at a time. Null urls are left out. An empty table gives no archive and no row. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.llm import common

LEAST_BYTES, HOT, ROLL_BYTES = 100, 1000, 1 << 30
#: Fixed value: the profile of the WARC standard for revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{url}')}>"


def _uri(url: str) -> str:
    """No line may end inside a header."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, first: int | None, first_url: str | None, date: str) -> bytes:
    """One WARC record as a gzip member."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, url)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest, first_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {first}"]
        if first_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(first_url)}")
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def read_records(file):
    """(headers, block) of each record of an archive, one at a time."""
    stream = gzip.GzipFile(fileobj=file)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        yield headers, stream.read(int(headers["Content-Length"]))


def resolve(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, first and first_url (null: a response)."""
    rows = common.pick(pages, page_id="long", url="string", html="string").withColumn("payload", common.utf8("html")).drop("html")
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    headers = rows.filter((F.col("n_bytes") >= least) & F.col("page_id").isNotNull()).select("digest", F.struct("page_id", "url").alias("at"))
    firsts = common.materialize(headers.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "n", "first.page_id", "first.url"), "firsts")
    bound = pages.count() / HOT
    hot = firsts.filter(F.col("n") > bound).select(F.col("digest"), F.col("page_id").alias("hot_id"), F.col("url").alias("hot_url"))
    rest = firsts.filter(F.col("n") <= bound).select(F.col("digest").alias("key"), F.col("page_id").alias("rest_id"), F.col("url").alias("rest_url"))
    # At most HOT digests can each have more than 1 / HOT of the rows.
    met = rows.join(F.broadcast(hot), "digest", "left")
    refers = F.col("hot_id").isNull() & (F.col("n_bytes") >= least) & F.col("page_id").isNotNull()
    met = met.withColumn("key", F.when(refers, F.col("digest")).otherwise(F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))))
    both = met.join(rest, "key", "left").withColumn("first", F.coalesce("hot_id", "rest_id")).withColumn("first_url", F.coalesce("hot_url", "rest_url"))
    again = (F.col("page_id") > F.col("first")) & (F.col("n_bytes") >= least)
    return both.select("page_id", "url", F.when(F.coalesce(again, F.lit(False)), F.lit(None)).otherwise(F.col("payload")).alias("payload"), "n_bytes", "digest", F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))


def write_archives(pages: DataFrame, directory: str, least: int = LEAST_BYTES, roll: int = ROLL_BYTES, date: str | None = None) -> DataFrame:
    """Writes deduplicated archives below ``directory``, which all executors share; returns path and n_records of each. ``date`` defaults to now."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        part, done, out, uri, n, size = TaskContext.get().partitionId(), [], None, "", 0, 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(7))):
                if out is None:
                    uri, n, size = f"{directory}/pages-{part:06d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                    out = common.create(uri)
                data = record(row[0], row[1], row[2] or b"", *row[3:], date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    out.close()
                    done, out = [*done, (uri, n)], None
        if out is not None:
            out.close()
            done.append((uri, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return common.materialize(resolve(pages, least).mapInArrow(write, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record; the digest of a response is taken anew from its payload and must be that of its header."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    whole = lambda x: int(x) if x is not None else None

    def read(batches):
        for b in batches:
            for uri in b.column("path").to_pylist():
                rows, (fs, path) = [], common.open_fs(uri)
                with fs.open_input_file(path) as file:
                    for headers, block in read_records(file):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        if headers["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have its digest")
                        rows.append((whole(headers.get("X-Page")), n, digest, headers["WARC-Type"], whole(headers.get("X-Refers-To-Page"))))
                for at in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 8192]), schema)], schema=schema)

    return archives.repartition(max(1, archives.count())).mapInArrow(read, SCHEMA)


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc")))


#: The rows that the archives must give back.
SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST_BYTES} GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.n >= {LEAST_BYTES} AND p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= {LEAST_BYTES} AND p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

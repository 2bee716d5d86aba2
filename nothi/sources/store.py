"""Tables of records, documents and search logs: reading, writing, keyed changes.

A table is a folder of versions (``versions``). Every change is a new DataFrame; ``commit`` writes a new version beside the old one, so readers see the old rows or the new, and
``open_table`` falls back to the version before where the newest is broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.functions.bengali import text
from nothi.sources.versions import Versioned, json_with_backup

#: Application names and column names of the three tables.
RECORD_COLUMNS = {
    "id": "id", "nid": "nid", "voterNo": "voter_no", "nameBn": "name_bn", "nameEn": "name_en", "fatherName": "father_name", "motherName": "mother_name", "dob": "dob", "village": "village", "gender": "gender", "bloodGroup": "blood_group", "photoUrl": "photo_url",
    "status": "status", "pdfPageNumber": "page_number", "serialNo": "serial_no", "occupation": "occupation", "unionName": "union_name", "wardNo": "ward_no", "voterArea": "voter_area", "voterAreaNo": "voter_area_no", "upazila": "upazila", "district": "district",
    "postCode": "post_code", "publicationDate": "publication_date", "pdfUploadId": "pdf_upload_id",
}
UPLOAD_COLUMNS = {
    "id": "id", "fileName": "file_name", "fileSize": "file_size", "district": "district", "upazila": "upazila", "unionName": "union_name", "wardNo": "ward_no", "voterArea": "voter_area", "voterAreaNo": "voter_area_no", "totalVoters": "total_voters",
    "totalFemaleVoters": "total_female_voters", "voterCount": "voter_count", "genderType": "gender_type", "publicationDate": "publication_date", "postCode": "post_code", "status": "status", "uploadedAt": "uploaded_at",
}
LOG_COLUMNS = {"id": "id", "dateTime": "date_time", "ipAddress": "ip_address", "query": "query", "responseTime": "response_time", "status": "status", "method": "method"}
DEFAULTS = {"status": "সক্রিয়", "gender_type": "উভয়"}
UPLOAD_STATUS, LOG_KEPT, BATCH = "সফল", 1000, 500


def to_columns(df: DataFrame, names: dict[str, str], defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """Application rows as table rows: renamed, empty texts and zeros null, numbers as text where the table has text, defaults filled in."""
    out = []
    for app, column in names.items():
        if app not in df.columns:
            continue
        c = F.col(app)
        kind = dict(df.dtypes)[app]
        if column in ("serial_no", "page_number"):
            c = c.cast("string")
        if kind == "string" or column in ("serial_no", "page_number"):
            c = F.nullif(c, F.lit(""))
        elif kind in ("int", "bigint", "double"):
            c = F.nullif(c, F.lit(0).cast(kind))
        if column in defaults:
            c = F.coalesce(c, F.lit(defaults[column]))
        out.append(c.alias(column))
    return df.select(*out)


def from_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Table rows as application rows: nulls become empty texts, page numbers numbers."""
    out = []
    for app, column in names.items():
        if column not in df.columns:
            continue
        c = F.col(column)
        if column == "page_number":
            c = c.try_cast("int")
        elif dict(df.dtypes)[column] == "string":
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(app))
    return df.select(*out)


def uploads_from_columns(df: DataFrame) -> DataFrame:
    return from_columns(df, UPLOAD_COLUMNS).withColumn("safeFileName", F.concat("id", F.lit(".pdf")))


def scan_json(spark: SparkSession, path: str, schema: str) -> dict[str, DataFrame]:
    """A document with the arrays voters, pdfs and searchLogs as three tables: the file, else its backup, which then takes its place; else empty tables."""
    whole = json_with_backup(spark, path, schema)
    return {name: whole.select(F.explode(name).alias("r")).select("r.*") for name in ("voters", "pdfs", "searchLogs") if name in whole.columns}


def commit(df: DataFrame, path: str) -> None:
    """Replaces the table at ``path``; the version before stays (``versions``)."""
    Versioned(df.sparkSession, path).commit(df)


def open_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of the table, else None."""
    return Versioned(spark, path).read()


def append(df: DataFrame, path: str, rows_a_file: int | None = None) -> None:
    Versioned(df.sparkSession, path).append(df, rows_a_file)


def prepend(df: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New rows before all others in ``order``."""
    least = df.agg(F.min(order)).head()[0] or 0
    return df.unionByName(new.withColumn(order, F.lit(least) - 1 - F.col(order)), allowMissingColumns=True)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def set_by_id(df: DataFrame, key: str, value, column: str, new) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) == value, F.lit(new).cast(dict(df.dtypes)[column])).otherwise(F.col(column)))


def without_ids(df: DataFrame, ids: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is not among ``ids``; null keys stay."""
    return df.join(ids.select(F.col(other or key).alias(key)).distinct(), key, "left_anti")


def removed_count(df: DataFrame, ids: DataFrame, key: str, other: str | None = None) -> DataFrame:
    return df.join(ids.select(F.col(other or key).alias(key)).distinct(), key, "left_semi").agg(F.count("*").alias("removed"))


def cascade_delete(parents: DataFrame, children: DataFrame, ids: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and their children without the given parents."""
    return without_ids(parents, ids, parent_key), without_ids(children, ids, child_key, parent_key)


def replace_by_source(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the sources that ``new`` has are replaced by its rows."""
    return without_ids(df, new, key).unionByName(new)


def update_with_fallback(df: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where they are filled, else the old ones."""
    other = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(other, key, "left")
    kinds = dict(df.dtypes)
    pick = lambda c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("" if kinds[c] == "string" else 0).cast(kinds[c])), F.col(c)).alias(c)
    return joined.select(*[pick(c) if c in columns else F.col(c) for c in df.columns])


def with_parent(children: DataFrame, parents: DataFrame, on: tuple[str, str], columns: dict[str, str], missing: str = "—") -> DataFrame:
    """Per field the child's value, else its parent's, else a dash. ``columns``: child column -> parent column."""
    side = parents.select(F.col(on[1]).alias(on[0]), *[text(p).alias(f"_{c}") for c, p in columns.items()]).dropDuplicates([on[0]])
    joined = children.join(side, on[0], "left")
    return joined.select(*[c for c in children.columns if c not in columns], *[F.coalesce(F.nullif(text(c), F.lit("")), F.nullif(F.col(f"_{c}"), F.lit("")), F.lit(missing)).alias(c) for c in columns])


def write_log_lines(df: DataFrame, path: str, level: str = "INFO") -> None:
    """Log rows (with ``level``) as JSON lines, from a level upward."""
    rank = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3}
    keep = [k for k, v in rank.items() if v >= rank[level]]
    df.filter(F.col("level").isin(keep)).write.mode("append").json(path)


def read_blobs(spark: SparkSession, path: str, most: int = 50 << 20) -> DataFrame:
    """Files with their bytes, without the too large ones."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)


def read_jdbc(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table; the driver's jar must be on the class path. With ``by``, a column of whole numbers or times, it is read in parts between its least and largest value.

    Filters, columns and limits of the result go to the database.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if by:
        low, high = reader.option("query", f"SELECT MIN({by}) AS lo, MAX({by}) AS hi FROM {table}").load().first()
        if low is not None:
            reader = spark.read.format("jdbc").options(url=url, **options).options(partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
            return reader.option("dbtable", table).load()
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


class FailedBatch(RuntimeError):
    """A batch that the database refused; ``written`` rows of the batches before it are there."""

    def __init__(self, written: int, why: str):
        super().__init__(f"stopped after {written} rows: {why}")
        self.written = written


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = BATCH, **options: str) -> None:
    """Appends rows in batches; a task's rows count together or not at all."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def write_jdbc_in_order(df: DataFrame, url: str, table: str, order: str, batch: int = BATCH, groups: int = 16, **options: str) -> int:
    """Appends rows in the order of a column, a group of them at a time, and stops at the first that the database refuses: what came before is there, what comes after isn't. Returns the rows written.

    Groups are ranges of ``order`` with about as many rows each; rows that share a value are in one group.
    """
    bounds = df.stat.approxQuantile(order, [i / groups for i in range(1, groups)], 0.001) if groups > 1 else []
    edges, written = [None, *sorted(set(bounds)), None], 0
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.filter(F.col(order) > low)
        part = part if high is None else part.filter(F.col(order) <= high)
        try:
            # One transaction for each group.
            write_jdbc(part.coalesce(1), url, table, batch, **options)
        except Exception as e:  # noqa: BLE001
            raise FailedBatch(written, str(e).splitlines()[0]) from e
        written += part.count()
    return written

"""Search by an inverted index of bigrams: which records hold a pair of letters, written at ingest.

Every indexed column has two fields: the value (lower case, without white space) and its search key. ``write`` keeps one row per record, field and bigram, with the number of the record's
bigrams; rows are dealt into buckets by their bigram, which are folders, and sorted in them, so a query opens the folders of its own bigrams and skips the row groups of others. A
bigram of many records is dealt out over several files. ``counts`` says how many records have each bigram.

*Parts.* A value that contains a term has all bigrams of the term. So the records that have its ``FEW`` rarest ones are candidates, whatever else they have, and common bigrams are not read.
*Likeness.* A record with a Jaccard likeness of t has at least t times the term's q bigrams, so it has one of any q - ceil(t q) + 1 of them, of which the rarest are
read, and it has between t q and q / t bigrams itself. Candidates are compared with the whole predicate, so both give the rows that a scan gives. Terms of one letter have no bigram and are
scanned for.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.functions.similarity import jaccard, ngrams
from nothi.operators import search
from nothi.sources import scratch

BUCKETS, ROWS_A_FILE, FEW = 64, 1_000_000, 4
#: So many candidates become a filter of the scan; more are joined.
LISTED = 1000
_GLUE = "\x01"


def grams_of(term: str) -> set[str]:
    """The bigrams of a term, as ``similarity.ngrams`` takes them from a column."""
    clean = re.sub("[\\s﻿]+", "", term).lower()
    return {clean[i : i + 2] for i in range(len(clean) - 1)}


def _bucket(field: str, gram: str, buckets: int) -> int:
    return zlib.crc32(f"{field}{_GLUE}{gram}".encode()) % buckets


def _posted(df: DataFrame, key: str, columns: Iterable[str], buckets: int) -> DataFrame:
    fields = [F.struct(F.lit(name).alias("field"), ngrams(name, 2).alias("grams")) for c in columns for name in (c, f"key_{c}")]
    rows = df.select(F.col(key).alias("id"), F.explode(F.array(*fields)).alias("f")).select("id", "f.field", F.size("f.grams").alias("n"), F.explode("f.grams").alias("gram"))
    return rows.withColumn("bucket", (F.crc32(F.concat_ws(_GLUE, "field", "gram").cast("binary")) % buckets).cast("int"))


def _dealt(rows: DataFrame, counts: DataFrame, rows_a_file: int) -> DataFrame:
    """The rows by bucket; a bigram of many records is spread over several parts."""
    # At most one in rows_a_file of the rows, so that it is broadcast and the rows are shuffled once.
    hot = counts.filter(F.col("records") > rows_a_file).select("field", "gram", F.ceil(F.col("records") / rows_a_file).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(hot), ["field", "gram"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(-1)).cast("int"))
    return dealt.repartition("bucket", F.when(F.col("part") >= 0, F.col("gram")), "part").sortWithinPartitions("bucket", "field", "gram", "id")


@dataclass(frozen=True)
class Postings:
    """An index at ``path``. ``key`` is unique among the records."""

    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]
    #: The type of the key.
    kind: str = "string"
    buckets: int = BUCKETS

    def add(self, records: DataFrame, rows_a_file: int = ROWS_A_FILE) -> "Postings":
        """Adds records (with their search keys) to the index."""
        rows = _posted(records, self.key, self.columns, self.buckets)
        counts = rows.groupBy("bucket", "field", "gram").agg(F.count("*").alias("records"))
        # Counted once; one row for each bigram.
        path = scratch.path(self.spark, "counts")
        counts.write.parquet(path)
        counts = self.spark.read.schema(counts.schema).parquet(path)
        counts.repartition("bucket").sortWithinPartitions("bucket", "field", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/counts")
        dealt = _dealt(rows, counts, rows_a_file)
        dealt.select("bucket", "field", "gram", "n", "id").write.mode("append").option("maxRecordsPerFile", rows_a_file).partitionBy("bucket").parquet(f"{self.path}/postings")
        return self

    def _asked(self, table: str, wanted: Iterable[tuple[str, str]]) -> DataFrame:
        wanted = sorted(wanted)
        by_field: dict[str, list[str]] = {}
        for field, gram in wanted:
            by_field.setdefault(field, []).append(gram)
        which = F.lit(False)
        for field, grams in by_field.items():
            which = which | ((F.col("field") == field) & F.col("gram").isin(grams))
        schema = "field string, gram string, records long, bucket int" if table == "counts" else f"field string, gram string, n int, id {self.kind}, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").filter(F.col("bucket").isin(sorted({_bucket(f, g, self.buckets) for f, g in wanted})) & which)

    def counts(self, wanted: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Records of each (field, bigram)."""
        wanted = set(wanted)
        found = self._asked("counts", wanted).groupBy("field", "gram").agg(F.sum("records").alias("n")).collect() if wanted else []
        return dict.fromkeys(wanted, 0) | {(r.field, r.gram): r.n for r in found}

    def having(self, conditions: list[set[tuple[str, str]]], few: int = FEW) -> DataFrame:
        """id of the records that may have all bigrams of one of the conditions, by the rarest ones of each."""
        n = self.counts(set().union(*conditions))
        chosen = [sorted(c, key=lambda g: (n[g], g))[:few] for c in conditions if all(n[g] for g in c)]
        rows = self._asked("postings", {g for c in chosen for g in c})
        if not chosen:
            return rows.filter("false").select("id")
        one = lambda g: (F.col("field") == g[0]) & (F.col("gram") == g[1])
        any_of = lambda c: [F.when(one(g), 1) for g in c]
        counted = rows.groupBy("id").agg(*[F.count(F.coalesce(*any_of(c))).alias(f"c{i}") for i, c in enumerate(chosen)])
        enough = F.lit(False)
        for i, c in enumerate(chosen):
            enough = enough | (F.col(f"c{i}") == len(c))
        return counted.filter(enough).select("id")

    def near(self, field: str, grams: set[str], threshold: float) -> DataFrame:
        """id of the records whose bigrams may have a likeness of ``threshold`` with the given ones."""
        q, n = len(grams), self.counts({(field, g) for g in grams})
        need = max(1, math.ceil(threshold * q - 1e-9))
        rarest = sorted(n, key=lambda g: (n[g], g))[: q - need + 1]
        fits = F.col("n").between(math.ceil(threshold * q - 1e-9), math.floor(q / threshold + 1e-9))
        return self._asked("postings", rarest).filter(fits).select("id").distinct()

    def of(self, records: DataFrame, candidates: DataFrame) -> DataFrame:
        """The records of the candidates: few are asked for by a filter that the scan takes, more by a join."""
        ids = [r.id for r in candidates.limit(LISTED + 1).collect()]
        if len(ids) <= LISTED:
            return records.filter(F.col(self.key).isin(ids))
        return records.join(candidates.withColumnRenamed("id", self.key), self.key, "left_semi")

    def matching(self, records: DataFrame, column: str, term: str) -> DataFrame:
        """The records whose column matches the term in the phonetic mode."""
        whole, asked = search.matches(column, f"key_{column}", term), search.key_of(term)
        words = [w for w in asked.split(" ") if len(w) >= 2]
        parts = [{(column, g) for g in grams_of(term)}]
        if asked:
            parts.append({(f"key_{column}", g) for g in grams_of(asked)})
        if len(words) > 1:
            parts.append({(f"key_{column}", g) for w in words for g in grams_of(w)})
        if not term or not all(parts):
            return records.filter(whole)
        return self.of(records, self.having(parts)).filter(whole)

    def alike(self, records: DataFrame, column: str, term: str, threshold: float = search.FUZZY) -> DataFrame:
        """The records whose column's key is alike the term's, with ``score``."""
        asked = search.key_of(term)
        score = jaccard(ngrams(f"key_{column}", 2), ngrams(F.lit(asked), 2))
        grams = grams_of(asked)
        found = self.of(records, self.near(f"key_{column}", grams, threshold)) if grams and threshold > 0 else records
        return found.withColumn("score", score).filter(F.col("score") >= threshold)


def write(records: DataFrame, key: str, columns: Iterable[str], path: str, buckets: int = BUCKETS, rows_a_file: int = ROWS_A_FILE) -> Postings:
    """The index of the given columns of records that have their search keys (``search.with_keys``)."""
    index = Postings(records.sparkSession, path, key, tuple(columns), records.schema[key].dataType.simpleString(), buckets)
    return index.add(records, rows_a_file)


def files_read(index: Postings, wanted: Iterable[tuple[str, str]]) -> int:
    """How many of the index's files hold rows of the given (field, bigram) pairs."""
    return index._asked("postings", wanted).select(F.input_file_name().alias("f")).distinct().count()

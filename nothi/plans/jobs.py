"""Long jobs over a table that can be stopped and go on: parts by key, each done once.

A table is dealt into parts by a hash of its key. Each part's rows go through a step and are written to a folder of their own; then one row of progress is appended (``versions``), which is what makes the part
count. A job that is started again, in the same work folder, goes on with the parts that have no row; a part that was written without one is written again to another folder, so no row is there
twice. When all parts are done their rows are the result. A dry run counts what would change and writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.plans import repair
from nothi.sources import store
from nothi.sources.versions import Versioned

PARTS = 16
PROGRESS = "part int, folder string, processed long, modified long"


def part_of(key: str, parts: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")


class Job:
    """``step`` makes of rows (of the table's columns) rows of a fixed schema with a boolean ``changed``."""

    def __init__(self, spark: SparkSession, work: str, step: Callable[[DataFrame], DataFrame], key: str = "id", parts: int = PARTS, preview: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.work, self.step, self.key, self.parts, self.preview = spark, work.rstrip("/"), step, key, parts, preview or step
        self.log = Versioned(spark, f"{self.work}/progress")

    def progress(self) -> DataFrame:
        """One row for each part that is done."""
        done = self.log.read(PROGRESS)
        # A part counts once, should two runs have done it.
        return done.groupBy("part").agg(F.min_by(F.struct("folder", "processed", "modified"), "folder").alias("r")).select("part", "r.*")

    def _todo(self) -> list[int]:
        done = {r.part for r in self.progress().select("part").collect()}
        return [p for p in range(self.parts) if p not in done]

    def run(self, table: DataFrame, most: int | None = None) -> bool:
        """Does the parts that are left, or ``most`` of them; returns whether all are done."""
        left = self._todo()
        for part in left[:most]:
            folder = f"{self.work}/parts/{part:05d}-{uuid.uuid4().hex}"
            self.step(table.filter(part_of(self.key, self.parts) == part)).write.parquet(folder)
            counts = self.spark.read.parquet(folder).agg(F.count("*").alias("processed"), F.count_if("changed").alias("modified"))
            self.log.append(counts.select(F.lit(part).alias("part"), F.lit(folder).alias("folder"), "processed", "modified"))
        return not self._todo()

    def result(self) -> DataFrame:
        """All rows, when all parts are done."""
        if self._todo():
            raise RuntimeError("parts are left to do")
        folders = [r.folder for r in self.progress().orderBy("part").collect()]
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f) for f in folders])

    def summary(self) -> DataFrame:
        return self.progress().agg(F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"), F.coalesce(F.sum("modified"), F.lit(0)).alias("modified"))

    def dry_run(self, table: DataFrame) -> DataFrame:
        """What ``summary`` would say, by ``preview``, without writing."""
        return self.preview(table).agg(F.count("*").alias("processed"), F.coalesce(F.count_if("changed"), F.lit(0)).alias("modified"))


def repair_job(spark: SparkSession, work: str, key: str = "id", parts: int = PARTS) -> Job:
    """The repair of texts, names and places (``repair.corrected``), with the counts by kind and fresh search keys. A dry run looks at names as they were read, so its counts may differ from those of a run."""

    def step(rows: DataFrame, as_read: bool = False) -> DataFrame:
        done = repair.corrected(rows, key, names_as_read=as_read)
        return repair.with_keys(done).withColumn("changed", F.col("n_dict") + F.col("n_name") + F.col("n_geo") > 0)

    return Job(spark, work, step, key, parts, preview=lambda rows: step(rows, True))


def replace_job(spark: SparkSession, work: str, columns: list[str], pairs: list[tuple[str, str]], key: str, parts: int = PARTS) -> Job:
    """Ordered replacements of parts of texts."""
    return Job(spark, work, lambda rows: repair.replace_parts(rows, columns, pairs), key, parts)


def reparse(table: Versioned, sources: DataFrame, parse: Callable[[DataFrame], DataFrame], work: str, source: str = "doc", parts: int = PARTS) -> int:
    """Parses sources (one row each) again and replaces their records in the table, in one new version; a source that gives no record keeps its old ones. Returns how many sources were replaced.

    The parsing is a job that goes on where it was stopped, and the table changes once, when all of it is there.
    """
    job = Job(table.spark, work, lambda rows: parse(rows).withColumn("changed", F.lit(True)), source, parts)
    job.run(sources)
    new = job.result().drop("changed")
    old = table.read()
    table.commit(store.replace_by_source(old, new.select(*old.columns), source) if old is not None else new)
    return new.select(source).distinct().count()

"""Where tables live: a folder or a database, behind the same four calls."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from nothi.sources import store


@dataclass
class Folder:
    root: str

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        return store.open_table(spark, f"{self.root}/{table}")

    def append(self, df: DataFrame, table: str) -> None:
        store.append(df, f"{self.root}/{table}")

    def replace(self, df: DataFrame, table: str) -> None:
        store.commit(df, f"{self.root}/{table}")


@dataclass
class Database:
    url: str
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str, by: str | None = None) -> DataFrame:
        return store.read_jdbc(spark, self.url, table, by, **self.options)

    def append(self, df: DataFrame, table: str) -> None:
        store.write_jdbc(df, self.url, table, **self.options)

    def replace(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").options(url=self.url, dbtable=table, truncate="true", **self.options).mode("overwrite").save()


def choose(root: str, url: str | None = None, **options: str) -> Folder | Database:
    """The database if one is named, else the folder."""
    return Database(url, options) if url else Folder(root)

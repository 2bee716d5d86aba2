"""Totals, cards and lists for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nothi.functions.bengali import first_filled, text, ward_from_text
from nothi.functions.misc import address_parts
from nothi.operators.search import GENDERS


def totals(uploads: DataFrame, logs: DataFrame, count: str = "voter_count") -> DataFrame:
    """One row: documents, records in them, searches."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = uploads.select(one.alias("d"), F.coalesce(F.col(count).cast("long"), none).alias("r"), none.alias("s")).unionAll(logs.select(none, none, one))
    total = lambda c, name: F.coalesce(F.sum(c), none).alias(name)
    return both.agg(total("d", "documents"), total("r", "records"), total("s", "searches"))


def area_cards(uploads: DataFrame) -> DataFrame:
    """Place, area and the total that the document's gender type calls for."""
    shown = F.when(F.col("gender_type") == GENDERS["female"], F.col("total_female_voters")).otherwise(F.col("total_voters"))
    return uploads.select("id", F.concat_ws(" › ", text("district"), text("upazila"), text("union_name")).alias("place"), F.col("voter_area").alias("area"), F.coalesce(shown, F.lit(0)).alias("shown"), "gender_type")


def shown_records(df: DataFrame) -> DataFrame:
    """Search results as shown: places from the address where empty, a ward from the area's text, defaults."""
    out = df.withColumn("_a", address_parts("address", "village", "upazila", "district"))
    return out.select(
        "id", text("name").alias("name"), F.col("_a.village").alias("village"), F.col("_a.upazila").alias("upazila"), F.col("_a.district").alias("district"), first_filled("ward", ward_from_text("area")).alias("ward"), first_filled("gender", F.lit(GENDERS["male"])).alias("gender")
    )


def shown_logs(logs: DataFrame, n: int = 50) -> DataFrame:
    """The latest searches with their time as text."""
    return logs.orderBy(F.col("date_time").desc(), "id").limit(n).select("id", F.date_format("date_time", "yyyy-MM-dd HH:mm:ss").alias("at"), text("query").alias("query"), first_filled("status", F.lit("Success")).alias("status"))


def lookup_stats(names: DataFrame, places: DataFrame) -> DataFrame:
    """what and n: sizes of lookup tables, of names (kind, name) by kind and of places (district, division) by level."""
    kinds = names.groupBy(F.col("kind").alias("what")).agg(F.count_distinct("name").alias("n"))
    levels = places.agg(F.count_distinct("district").alias("districts"), F.count_distinct("division").alias("divisions"))
    return kinds.unionByName(levels.unpivot([], ["districts", "divisions"], "what", "n"))

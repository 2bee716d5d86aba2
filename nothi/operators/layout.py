"""Page layout: columns and lines from positioned text items.

Items have (doc, page, seq, str, x, y, width, height). Columns come from counts by page and x. Lines are grouped by distance from the group's
first item, not from the item before; that is a fold over a page column's items in order, done in one pass over a sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nothi.functions.bengali import SPACE, strip

NARROW, WIDE_SHARE, TOLERANCE = 150.0, 0.4, 4.0
#: Where the two dividers are looked for, and where they are without two items there, in shares of the page's range.
FIRST, SECOND = (0.20, 0.45, 0.33), (0.55, 0.80, 0.66)


def usable_items(items: DataFrame, first_page: int = 1, skipped: tuple[int, ...] = (2,)) -> DataFrame:
    """Items with text, without skipped pages."""
    return items.filter((F.length("str") > 0) & (F.col("page") >= first_page) & ~F.col("page").isin(*skipped))


def columns(items: DataFrame, page: list[str] | None = None) -> DataFrame:
    """Adds ``column`` (1 to 3 from the left, numbered without gaps) to every item.

    A page under 150 wide is one column. Else each divider is the middle of the widest gap between neighbouring starts in its range; the first of equal gaps counts.
    """
    page, x = page or ["doc", "page"], F.col("x")
    # Where an item lies depends on its page and x alone, so items are counted by them, and no page's items stand together.

    def of_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
        """Rows with what is known of their page (``_page`` is a struct, so that null keys meet)."""
        return rows.join(pages, F.struct(*page).eqNullSafe(F.col("_page"))).drop("_page")

    whole = items.groupBy(F.struct(*page).alias("_page")).agg(F.min("x").alias("_lo"), (F.max("x") - F.min("x")).alias("_range"))
    narrow = F.coalesce(F.coalesce("width", F.lit(0.0)) < F.col("_range") * WIDE_SHARE, F.lit(False))
    cells = of_page(items, whole).groupBy(F.struct(*page).alias("_page"), "_lo", "_range", "x").agg(F.count_if(narrow).alias("_n"))
    at = {}
    for name, (low, high, default) in (("_b1", FIRST), ("_b2", SECOND)):
        inside = F.coalesce((F.col("_n") > 0) & (x >= F.col("_lo") + F.col("_range") * low) & (x <= F.col("_lo") + F.col("_range") * high), F.lit(False))
        cells = cells.withColumn(f"_in{name}", inside)
        # Items with one x are no gap apart.
        after = F.coalesce(F.lead("x").over(Window.partitionBy("_page", f"_in{name}").orderBy("x")), F.when(F.col("_n") > 1, x))
        gap = F.when(inside & after.isNotNull(), F.struct((after - x).alias("g"), (-x).alias("f"), ((x + after) / 2).alias("at")))
        cells = cells.withColumn(f"_gap{name}", gap)
        at[name] = F.coalesce(F.max(f"_gap{name}")["at"], F.first("_lo") + F.first("_range") * default).alias(name)
    bucket = F.when(F.col("_range") < NARROW, 1).when(x < F.col("_b1"), 1).when(x < F.col("_b2"), 2).otherwise(3)
    split = cells.groupBy("_page").agg(F.first("_range").alias("_range"), *at.values())
    used = cells.select("_page", "x").join(split, "_page").groupBy("_page").agg(F.first("_range").alias("_range"), F.first("_b1").alias("_b1"), F.first("_b2").alias("_b2"), F.sort_array(F.collect_set(bucket)).alias("_used"))
    return of_page(items, used).withColumn("column", F.array_position("_used", bucket).cast("int")).drop("_range", "_b1", "_b2", "_used")


def _group_starts(ordered: Column, tolerance: float) -> Column:
    """Places (from 0) in an array in descending order of y at which a group begins: where y is over ``tolerance`` from the group's first."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("double").alias("y"), F.lit(0).alias("i"))

    def step(acc: Column, item: Column) -> Column:
        new = acc["y"].isNull() | (F.abs(item["y"] - acc["y"]) > tolerance)
        return F.struct(F.when(new, F.concat(acc["out"], F.array(acc["i"]))).otherwise(acc["out"]).alias("out"), F.when(new, item["y"]).otherwise(acc["y"]).alias("y"), (acc["i"] + 1).alias("i"))

    return F.aggregate(ordered, start, step)["out"]


def line_groups(items: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``line`` (from 1, top to bottom) to the items of each key."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("_o"), F.col("x"), F.col("seq"), F.col("y"), F.col("str"), F.col("width"), F.col("height"))))
    pages = items.groupBy(*keys).agg(ordered.alias("_i")).withColumn("_s", _group_starts(F.col("_i"), tolerance))
    rows = pages.select(*keys, "_s", F.posexplode("_i").alias("_at", "_p"))
    return rows.select(*keys, F.size(F.filter("_s", lambda s: s <= F.col("_at"))).alias("line"), *[F.col(f"_p.{c}").alias(c) for c in ("seq", "str", "x", "y", "width", "height")])


def lines(items: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """One row per line: text from left to right (three spaces and more become a tab) and the box around it."""
    grouped = line_groups(items, keys, tolerance).groupBy(*keys, "line")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "seq", "str"))), lambda i: i["str"]), " ")
    text = strip(F.regexp_replace(joined, SPACE + "{3,}", "\t"))
    right, top = F.max(F.col("x") + F.coalesce("width", F.lit(0.0))), F.max(F.col("y") + F.coalesce("height", F.lit(0.0)))
    return grouped.agg(text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (top - F.min("y")).alias("height"))

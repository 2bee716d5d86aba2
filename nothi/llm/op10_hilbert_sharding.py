"""Hilbert-curve sharding.

Metadata dimensions (source, language, length) are quantised to equally many levels, the
levels give an index on the Hilbert curve, rows are sorted by it and cut into runs of
equal row counts, at most one apart. Neighbours on the curve are near in every dimension, so a
shard covers a small box and a reader can skip shards by the box of each (``shard_boxes``).
Equal texts of one cell lie side by side, as the checksum of the text follows the index in the order.

Null categories are level 0; null texts have size 16 and checksum 0. Null and repeated
doc_ids, and rows equal in everything, keep the order of the input. An empty table gives no
row. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nothi.llm import common

SHARDS, BITS, OVERHEAD = 40, 8, 16


def hilbert_index(levels: list[np.ndarray], bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points with ``bits`` bits in each dimension (Skilling's transform)."""
    x, n = [a.astype(np.int64).copy() for a in levels], len(levels)
    m = 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), m
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            index = index << 1 | ((x[i] ^ t) >> b & 1)
    return index


def category_level(column: str, bits: int) -> Column:
    """The level of a category: its checksum; the same for every table, so a reader can look a value up."""
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.crc32(F.col(column).cast("binary")) % (1 << bits)).cast("int")


def with_curve(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, level_source, level_lang, level_size, curve. The size levels are quantiles: 2**bits - 1 numbers, whatever the input."""
    text = common.utf8("text")
    rows = common.pick(docs, doc_id="long", text="string", source="string", lang="string").select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), category_level("source", bits).alias("level_source"), category_level("lang", bits).alias("level_lang")
    )
    cuts = rows.agg(F.percentile_approx("size", [i / (1 << bits) for i in range(1, 1 << bits)], 10_000)).head()[0] or []

    @F.pandas_udf("struct<level_size:int,curve:long>")
    def place(source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.DataFrame:
        length = np.searchsorted(np.array(cuts), size.to_numpy(), side="right")
        return pd.DataFrame({"level_size": length.astype("int32"), "curve": hilbert_index([source.to_numpy(), lang.to_numpy(), length], bits)})

    return rows.withColumn("_p", place("level_source", "level_lang", "size")).select("*", "_p.level_size", "_p.curve").drop("_p")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per document with its shard, its slot there and its levels.

    One range exchange of narrow rows; the global rank is the row's place in its partition plus the rows of the partitions before.
    """
    placed = with_curve(docs, bits).withColumn("_tie", F.monotonically_increasing_id())
    order = ["curve", "text_crc32", "doc_id", "_tie"]
    rows = common.materialize(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "curve")
    part, low = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    total = rows.count()
    # A row for each partition of the exchange: as many as spark.sql.shuffle.partitions at most.
    ranked = rows.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn("_rank", F.col("_base") + low)
    return ranked.withColumn("shard", F.expr(f"cast((_rank * {shards}) div {max(1, total)} as int)")).withColumn("slot", F.expr(f"_rank - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}")).drop("_part", "_base", "_rank", "_at")


def shard_boxes(rows: DataFrame) -> DataFrame:
    """The box of levels that each shard covers."""
    levels = ["level_source", "level_lang", "level_size"]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{n}_{c}") for c in levels for n, f in (("min", F.min), ("max", F.max))])


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert_shards(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "level_source", "level_lang", "level_size", "curve")

"""What the vector searches share: shards that are indexed once, and queries that visit them in rounds.

A shard's index is one row of a table: flat arrays. A round takes a block of queries, of bounded size, to every shard by
broadcast, so neither vectors nor queries are multiplied; its results are merged and written before the next round.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nothi.llm import common


def usable(vectors: DataFrame, zero_too: bool = True) -> DataFrame:
    """vec_id, v: vectors without null or non-finite components (nor null vec_ids); ``zero_too``: zero ones as well."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.forall("v", finite))
    return rows if zero_too else rows.filter(F.exists("v", lambda x: x != 0))


def sharded(rows: DataFrame, shard_rows: int, k: int) -> tuple[DataFrame, int]:
    """(vec_id, copies, v, dim, shard; number of shards).

    Of equal vectors only the k + 1 smallest vec_ids can be among the k best of any query, and of equal rows k; so a vector that many rows have fills no shard.
    """
    counted = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    first = counted.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    kept = common.materialize(first.select("vec_id", "copies", "v", F.size("v").alias("dim")), "vectors")
    shards = max(1, math.ceil(kept.count() / shard_rows))
    return kept.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")), shards


def indexed(candidates: DataFrame, shards: int, build: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """shard, dim, ids, x (row by row), lists: what ``build(ids, copies, rows)`` makes of each shard's vectors of one length, written once."""
    schema = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("lists", pa.list_(pa.list_(pa.int32())))])

    def make(t: pa.Table) -> pa.Table:
        shard, dim = t.column("shard")[0].as_py(), t.column("dim")[0].as_py()
        ids, x, lists = build(t.column("vec_id").to_numpy(), t.column("copies").to_numpy(), matrix(t.column("v"), np.float64))
        one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
        ends = np.cumsum([0, *(a.size for a in lists)]).astype(np.int32)
        inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a.ravel() for a in lists]) if lists else [], pa.int32()))
        return pa.table([pa.array([shard], pa.int32()), pa.array([dim], pa.int32()), one(ids, pa.int64()), one(np.ravel(x), pa.float64()), pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), inner)], schema=schema)

    made = candidates.repartition(shards, "shard").groupBy("shard", "dim").applyInArrow(make, "shard int, dim int, ids array<long>, x array<double>, lists array<array<int>>")
    return common.materialize(made, "index")


def searched(index: DataFrame, rows: DataFrame, every: int, query_rows: int, visit, score: str, k: int, ascending: bool) -> DataFrame:
    """query_id, rank, vec_id, score of all queries (rows whose vec_id is divisible by ``every``; of those that repeat a vec_id the smallest vector asks).

    ``visit(ids, x, lists, query_ids, queries)`` gives query_ids, vec_ids and scores of one shard's best.
    """
    asking = common.materialize(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    parts = max(1, math.ceil(asking.count() / query_rows))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score == "long" else pa.float64())])
    rounds = []
    for part in range(parts):
        block = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id").toArrow()
        dims = block.column("v").combine_chunks().value_lengths().to_numpy() if block.num_rows else np.empty(0, int)
        by_dim = {int(d): (b.column("vec_id").to_numpy(), matrix(b.column("v"), np.float64)) for d in np.unique(dims) for b in [block.filter(pa.array(dims == d))]}
        # About query_rows queries.
        sent = index.sparkSession.sparkContext.broadcast(by_dim)

        def run(batches, sent=sent):
            for b in batches:
                for i in range(b.num_rows):
                    dim = b.column("dim")[i].as_py()
                    if dim in sent.value:
                        ids, x = b.column("ids")[i].values.to_numpy(), b.column("x")[i].values.to_numpy().reshape(-1, dim)
                        lists = [s.values.to_numpy() for s in b.column("lists")[i].values] if len(b.column("lists")[i]) else []
                        found = visit(ids, x, lists, *sent.value[dim])
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

        found = index.mapInArrow(run, f"query_id long, vec_id long, score {score}")
        rounds.append(common.materialize(merged(found, k, ascending), "round"))
        sent.unpersist()
    return reduce(DataFrame.union, rounds)


def matrix(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0).astype(dtype)


def merged(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """The k best of every query over all shards, with ranks; ties to the smaller vec_id."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score, "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

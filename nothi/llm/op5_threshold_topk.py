"""Exact top-k by the threshold algorithm over sorted per-dimension lists.

Vectors are quantised to floor(64 * x) and dealt into shards. A shard keeps, for every dimension, its
rows in the order of that component; it is sorted once and written (see ``vectors``). For a query the lists are read from the end that adds most, all to the same depth;
each row that turns up is scored in full, and reading stops when the sum of the list heads' contributions, which no unseen
row can pass, is below the k-th best score; a tie at the bound reads on, so ties go to the smaller vec_id. Depth grows by a
sixteenth of the list. Queries visit the shards in rounds, and the shards' lists are merged.

Scores are exact: in double precision where no sum can reach 2**53, else in whole numbers of any size; a score that a long cannot hold is the
largest or smallest long. Components beyond 2**62 / 64 count as that.

Vectors that are null or empty, or hold a null or non-finite component, take no part; neither do null vec_ids. Rows that share the query's vec_id are its own.
Of rows that repeat a query's vec_id the smallest vector asks; repeated candidates are each listed. Vectors of another length than the query's take no part in its list.
An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nothi.llm import common, vectors

K, EVERY, SCALE, SHARD, QUERIES = 20, 20, 64, 16384, 32768
#: The longest list part that is read at once, as a share of the list; the largest component; the largest long.
STEP, MOST, LARGEST = 16, 2.0**62, 2**63 - 1


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """Whole numbers, as doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -MOST, MOST)


class SortedLists:
    """One shard: its rows and, for each dimension, their order by that component, the largest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray):
        self.ids, self.rows, self.order = ids, rows, order
        self.heads = np.take_along_axis(np.ascontiguousarray(rows.T), order, axis=1)
        self.most = float(np.abs(rows).max()) if rows.size else 0.0

    @classmethod
    def sort(cls, ids: np.ndarray, rows: np.ndarray) -> "SortedLists":
        by_id = np.argsort(ids, kind="stable")
        ids, rows = ids[by_id], np.asarray(rows, np.float64)[by_id]
        return cls(ids, rows, np.ascontiguousarray(np.argsort(-rows, axis=0, kind="stable").T.astype(np.int32)))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_ids, scores) of the k best, best first."""
        n, exact = len(self.ids), len(query) * self.most * float(np.abs(query).max(initial=0.0)) < 2.0**53
        whole = (lambda a: a) if exact else (lambda a: np.array([int(x) for x in a.ravel()], object).reshape(a.shape))
        query = np.asarray(query, np.float64)
        up, down, asks = np.flatnonzero(query > 0), np.flatnonzero(query < 0), whole(query)
        seen, best_at, best = np.zeros(n, bool), np.empty(0, np.int64), np.empty(0, np.float64 if exact else object)
        seen[slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))] = True
        depth, last = 0, max(2 * k, n // STEP) if len(up) or len(down) else n
        while depth < n:
            last, fresh = min(n, last), seen.copy()
            fresh[self.order[up, depth:last].ravel()] = True
            fresh[self.order[down, n - last : n - depth].ravel()] = True
            if not len(up) and not len(down):
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen = fresh
            if len(new):
                scores = whole(self.rows[new]) @ asks
                if not exact:
                    scores = np.array([min(LARGEST, max(-LARGEST - 1, s)) for s in scores], object)
                at, all_scores = np.concatenate([best_at, new]), np.concatenate([best, scores])
                if exact and len(at) > k:
                    held = all_scores >= np.partition(all_scores, len(at) - k)[len(at) - k]
                    at, all_scores = at[held], all_scores[held]
                # Rows are in the order of their ids.
                first = np.lexsort((at, -all_scores))[:k] if exact else sorted(range(len(at)), key=lambda i: (-all_scores[i], at[i]))[:k]
                best_at, best = at[first], all_scores[first]
            depth = last
            bound = whole(self.heads[up, depth - 1]) @ asks[up] + whole(self.heads[down, n - depth]) @ asks[down]
            if len(best) == k and bound < best[-1]:
                break
            last = depth + max(2 * k, n // STEP)
        return self.ids[best_at], best.astype(np.int64)


def search(vectors_: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard_rows: int = SHARD, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score."""
    rows = vectors.usable(vectors_)
    candidates, shards = vectors.sharded(rows, shard_rows, k)

    def build(ids, copies, x):
        made = SortedLists.sort(np.repeat(ids, copies), np.repeat(quantised(x, scale), copies, axis=0))
        return made.ids, made.rows, list(made.order)

    def visit(ids, x, lists, query_ids, queries):
        shard, out = SortedLists(ids, x, np.stack(lists)), ([], [], [])
        for query_id, query in zip(query_ids.tolist(), quantised(queries, scale)):
            found, scores = shard.top(query_id, query, k)
            for c, v in zip(out, (np.full(len(found), query_id), found, scores)):
                c.append(v)
        return [np.concatenate(c) for c in out]

    return vectors.searched(vectors.indexed(candidates, shards, build), rows, every, query_rows, visit, "long", k, ascending=False)


def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""

"""Centroid clustering with ball trees that filter centroids.

Every task puts the vectors it reads into trees of bounded size, without a shuffle, and writes them once. A node of a tree is a ball: the number and the whole-number sum of its
vectors, whose mean is its centre, and a radius. In a round each tree is gone down level by level with all centroids. By the triangle inequality a
centroid is out for a ball if even the ball's nearest point to it is farther than the farthest point is from another centroid; where one centroid
is left, the whole ball is its own, and its sum is added as it stands. Balls with several centroids are opened, down to
leaves, whose vectors are compared with the centroids exactly. Equal vectors are one ball of radius zero, so repeated ones cost nothing.
Distances to centres carry a margin far above their rounding, so no ball is given away that holds a tie. What leaves a task is one
sum for each tree and centroid.

Components are floor(scale * x). Sums, means (rounded down) and squared distances are whole numbers and exact: in double precision where no value can reach 2**53, else in Python's integers. Components beyond 2**49 count as
that; a distance or inertia that a long cannot hold is the largest long.

Centroids start as the vectors with the smallest sha256 of ``<seed>:<vec_id>``; of equal ones that with the smaller components comes first, and null vec_ids last. With fewer vectors than clusters each
is a centroid. Vectors that are null, have another length or hold a null or non-finite component take no part. Repeated vec_ids and repeated
rows are rows of their own. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.llm import common

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Vectors of one tree and of one leaf.
TREE, LEAF = 4096, 16
MOST, LARGEST = 1 << 49, (1 << 63) - 1
#: Above the rounding of a distance, in proportion.
MARGIN = 1e-9


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole numbers) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") == dim)).filter(F.forall("v", finite))
    whole = lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(float(-MOST))), F.lit(float(MOST))))
    return rows.select("vec_id", F.transform("v", whole).alias("v"))


class Tree(NamedTuple):
    """One ball tree as flat arrays. Vectors lie in the order of the leaves; node i holds those from begin[i] to end[i], its children are child[i] (0: a leaf) and the next one."""

    ids: list[int | None]
    x: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @classmethod
    def grow(cls, ids: list[int | None], x: np.ndarray, leaf: int = LEAF) -> "Tree":
        order, begin, end, child, radius, sums, i = np.arange(len(x)), [0], [len(x)], [], [], [], 0
        while i < len(begin):
            a, b = begin[i], end[i]
            part = x[order[a:b]]
            total = part.sum(axis=0)
            apart = part - total / (b - a)
            far = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            radius.append(float(far.max()) if (part != part[0]).any() else 0.0)
            sums.append(total)
            child.append(0)
            if b - a > leaf and radius[-1]:
                # Halves along the line between two far points.
                one = part[far.argmax()].astype(float)
                gap = part - one
                line = part[np.einsum("ij,ij->i", gap, gap).argmax()] - one
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part @ line, half)]
                child[-1] = len(begin)
                begin += [a, a + half]
                end += [a + half, b]
            i += 1
        return cls([ids[k] for k in order.tolist()], x[order], np.array(begin), np.array(end), np.array(child), np.array(radius), np.array(sums, np.int64).reshape(len(begin), -1))

    def placed(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls, the centroid of each; vectors, the centroid of each): every vector is in one of the balls or listed."""
        c, size = np.array(centroids, float), self.end - self.begin
        centre = self.sums / size[:, None]
        nodes, live = np.zeros(1, int), np.ones((1, len(c)), bool)
        balls, of_ball, leaves = [], [], []
        while len(nodes):
            d = np.sqrt(((centre[nodes][:, None] - c[None]) ** 2).sum(axis=2))
            r = self.radius[nodes][:, None]
            farthest = np.where(live, d + r, np.inf).min(axis=1, keepdims=True)
            live &= d - r <= farthest + MARGIN * (1 + d + r)
            sole = live.sum(axis=1) == 1
            balls.append(nodes[sole])
            of_ball.append(live[sole].argmax(axis=1))
            nodes, live = nodes[~sole], live[~sole]
            leaf = self.child[nodes] == 0
            leaves += [np.arange(a, b) for a, b in zip(self.begin[nodes[leaf]], self.end[nodes[leaf]])]
            left = self.child[nodes[~leaf]]
            nodes, live = np.concatenate([left, left + 1]), np.concatenate([live[~leaf]] * 2)
        points = np.concatenate(leaves) if leaves else np.zeros(0, int)
        return np.concatenate(balls), np.concatenate(of_ball), points, self.nearest(points, centroids)

    def exact(self, values) -> np.ndarray:
        """As doubles where squared distances stay below 2**53, else as Python's integers."""
        return np.asarray(values, float) if 4.0 * self.x.shape[1] * max(1, self._largest()) ** 2 < 2.0**53 else np.array(values, object)

    def _largest(self) -> int:
        return max(abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0))))

    def squared(self, points: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
        """Squared distances of vectors to centroids, one each."""
        gap = self.exact(self.x[points]) - self.exact(centroids)
        return (gap * gap).sum(axis=1)

    def nearest(self, points: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
        """The nearest centroid, the first of equally near ones."""
        out, c = np.zeros(len(points), int), self.exact(centroids)
        for at in range(0, len(points), 512):
            gap = self.exact(self.x[points[at : at + 512]])[:, None] - c[None]
            out[at : at + 512] = (gap * gap).sum(axis=2).argmin(axis=1)
        return out

    def summed(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the vectors of each centroid."""
        balls, of_ball, points, of_point = self.placed(centroids)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), self.x.shape[1]), np.int64)
        np.add.at(n, of_ball, (self.end - self.begin)[balls])
        np.add.at(sums, of_ball, self.sums[balls])
        np.add.at(n, of_point, 1)
        np.add.at(sums, of_point, self.x[points])
        return n, sums

    def assigned(self, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
        """The centroid of each vector and its squared distance."""
        balls, of_ball, points, of_point = self.placed(centroids)
        of = np.zeros(len(self.x), int)
        for node, c in zip(balls, of_ball):
            of[self.begin[node] : self.end[node]] = c
        of[points] = of_point
        far = self.squared(np.arange(len(self.x)), np.array(centroids, object)[of])
        return of, [min(LARGEST, int(d)) for d in far]


FOREST = "ids array<long>, x array<long>, begin array<int>, end array<int>, child array<int>, radius array<double>, sums array<long>"
_FOREST = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.list_(pa.int64())), *((n, pa.list_(pa.int32())) for n in ("begin", "end", "child")), ("radius", pa.list_(pa.float64())), ("sums", pa.list_(pa.int64()))])


def forest(vectors: DataFrame, tree_rows: int = TREE, leaf: int = LEAF) -> DataFrame:
    """One row per tree over rows (vec_id, v), each of vectors that one task read; written once."""

    def grow(batches):
        ids, held = [], []

        def rows(n):
            nonlocal ids, held
            x = np.concatenate(held)
            for at in range(0, n, tree_rows):
                t = Tree.grow(ids[at : at + tree_rows], x[at : at + tree_rows], leaf)
                yield pa.RecordBatch.from_arrays([pa.array([np.ravel(v) if isinstance(v, np.ndarray) else v], f.type) for v, f in zip(t, _FOREST)], schema=_FOREST)
            ids, held = ids[n:], [x[n:]]

        for b in batches:
            if b.num_rows:
                ids += b.column(0).to_pylist()
                held.append(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
                if len(ids) >= tree_rows:
                    yield from rows(len(ids) // tree_rows * tree_rows)
        if ids:
            yield from rows(len(ids))

    return common.materialize(vectors.mapInArrow(grow, FOREST), "forest")


def _trees(batches):
    for b in batches:
        for i in range(b.num_rows):
            ids, *flat = (b.column(k)[i].values for k in range(len(_FOREST)))
            x, begin, end, child, radius, sums = (a.to_numpy() for a in flat)
            yield Tree(ids.to_pylist(), x.reshape(len(ids), -1), begin, end, child, radius, sums.reshape(len(begin), -1))


def totals(trees: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Number and sum of the vectors of each centroid that has any."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        for t in _trees(batches):
            n, sums = t.summed(centroids)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], schema=schema)

    parts = trees.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "part"))
    summed = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    # Clusters times dimensions rows.
    out: dict[int, tuple[int, list[int]]] = {}
    for r in summed.orderBy("cluster", "i").collect():
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.total))
    return out


def seeds(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    # As many rows as clusters.
    return [list(r.v) for r in rows.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, tree_rows: int = TREE) -> tuple[DataFrame, list[list[int]], DataFrame]:
    """(vec_id, cluster, distance of every vector, written; the final centroids; the trees)."""
    rows = kept(vectors, dim, scale)
    trees, centroids = forest(rows, tree_rows), seeds(rows, clusters, seed)
    for _ in range(rounds if centroids else 0):
        found = totals(trees, centroids)
        centroids = [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids)]
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for t in _trees(batches):
            of, far = t.assigned(centroids)
            yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(of, pa.int32()), pa.array(far, pa.int64())], schema=schema)

    return common.materialize(trees.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned"), centroids, trees


def filter_report(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """One row: vectors, those that were given away in whole balls, and those compared in leaves."""
    schema = pa.schema([(n, pa.int64()) for n in ("vectors", "in_balls", "in_leaves")])

    def run(batches):
        for t in _trees(batches):
            _, _, points, _ = t.placed(centroids)
            counts = len(t.x), len(t.x) - len(points), len(points)
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in counts], schema=schema)

    return trees.mapInArrow(run, "vectors long, in_balls long, in_leaves long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in schema.names])


def op13_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids, _ = clustered(common.table(spark, sf_dir, "embeddings"))
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    long = lambda c: F.least(c, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    each = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    each = each.crossJoin(F.broadcast(each.agg(F.sum("d").alias("all")))).join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster")
    # One row per cluster.
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", long(F.col("d")).alias("cluster_inertia"), long(F.col("all")).alias("inertia"), "centroid_sha256")


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS c, v FROM kept QUALIFY c < {clusters})",
    ]
    near = "SELECT k.row, arg_min(m.c, (list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), m.c)) AS c FROM kept k, c{r} m GROUP BY k.row"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        steps.append(f"s{r} AS (SELECT a.c, i, sum(k.v[i]) AS s, count(*) AS n FROM a{r} a JOIN kept k USING (row), range(1, {dim + 1}) t(i) GROUP BY a.c, i)")
        steps.append(f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))")
    steps.append(f"last AS MATERIALIZED ({near.format(r=rounds)})")
    steps.append(f"d AS (SELECT k.vec_id, c, m.v, CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM kept k JOIN last USING (row) JOIN c{rounds} m USING (c))")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256 FROM d"""


SQL = _sql()

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nothi.llm import common
from nothi.llm import op13_ball_tree_clusters as op13
from tests.compare import connect, same

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string"


def plain(rows, k, rounds, scale=64):
    """(vec_id, cluster, distance) by comparing every vector with every centroid, in whole numbers."""
    v = [(i, [int(np.floor(float(x) * scale)) for x in e]) for i, e in rows]
    h = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    c = [x for _, x in sorted(v, key=lambda p: (h(p[0]), p[1]))[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    of = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        mine = [of(x) for _, x in v]
        c = [[sum(col) // len(col) for col in zip(*(x for (_, x), m in zip(v, mine) if m == j))] if j in mine else c[j] for j in range(len(c))]
    return [(i, of(x), min(op13.LARGEST, far(x, c[of(x)]))) for i, x in v], c


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, "y") for i, e in rows], SCHEMA)


KEY = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])


def points(n, dim, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    return [(i, (centres[i % 9] + spread * rng.normal(size=dim)).astype("f4").tolist()) for i in range(n)]


@pytest.mark.parametrize("k, rounds, tree", [(5, 3, 4096), (16, 2, 50), (3, 0, 7)])
def test_against_every_centroid(spark, k, rounds, tree):
    rows = points(1600, 8)
    assigned, centroids, trees = op13.clustered(frame(spark, rows), clusters=k, rounds=rounds, dim=8, tree_rows=tree)
    want, c = plain(rows, k, rounds)
    assert sorted(map(tuple, assigned.collect())) == sorted(want) and centroids == c
    seen = op13.filter_report(trees, centroids).first()
    assert seen.vectors == 1600 == seen.in_balls + seen.in_leaves and (seen.in_balls > 800 or tree < 4096)


def test_ties_go_to_the_first_centroid(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)]
    assigned, *_ = op13.clustered(frame(spark, rows), clusters=6, rounds=2, dim=2)
    assert sorted(map(tuple, assigned.collect())) == sorted(plain(rows, 6, 2)[0])


def test_equal_vectors_are_one_ball():
    t = op13.Tree.grow(list(range(5000)), np.ones((5000, 4), np.int64))
    assert len(t.begin) == 1 and t.radius[0] == 0.0
    balls, of, points_, _ = t.placed([[0] * 4, [1] * 4])
    assert balls.tolist() == [0] and of.tolist() == [1] and not len(points_)


def test_balls_hold_what_lies_below_them():
    x = np.random.default_rng(2).integers(-99, 99, (700, 5))
    t = op13.Tree.grow(list(range(700)), x, leaf=9)
    assert sorted(t.ids) == list(range(700)) and (t.x == x[t.ids]).all()
    for a, b, child, r, s in zip(t.begin, t.end, t.child, t.radius, t.sums):
        part = t.x[a:b]
        assert (part.sum(axis=0) == s).all() and np.linalg.norm(part - s / (b - a), axis=1).max() <= r + 1e-9
        assert not child or (t.begin[child], t.end[child + 1], t.end[child]) == (a, b, t.begin[child + 1])
        assert child or b - a <= 9


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(np.float32(1e6 * np.sin(i * j + 1))) for j in range(4)]) for i in range(90)]
    got = op13.clustered(frame(spark, rows), clusters=4, rounds=3, dim=4)[0].collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, 4, 3)[0])
    huge = [(i, [3e38 * (-1) ** i, float(i)]) for i in range(8)]
    far = [r.distance for r in op13.clustered(frame(spark, huge), clusters=2, rounds=1, dim=2)[0].collect()]
    assert len(far) == 8 and max(far) <= op13.LARGEST


def test_odd_rows(spark, tmp_path):
    good = points(40, 64) + [(None, [0.5] * 64), (None, [0.5] * 64), (3, [1.0] * 64), (3, [1.0] * 64), (50, [0.0] * 64)]
    bad = [(60, None), (61, []), (62, [1.0] * 63), (63, [None] + [1.0] * 63), (64, [float("nan")] + [1.0] * 63), (65, [float("inf")] * 64)]
    frame(spark, good + bad).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in op13.op13_ball_tree_clusters(spark, f"file://{tmp_path}").select("vec_id", "cluster", "distance").collect()]
    want, _ = plain(good, 16, 3)
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    same(op13.op13_ball_tree_clusters(spark, f"file://{tmp_path}"), op13.SQL, connect(str(tmp_path)))


def test_fewer_vectors_than_clusters_and_none(spark, tmp_path):
    frame(spark, points(3, 64)).write.parquet(f"file://{tmp_path}/a/embeddings.parquet")
    rows = op13.op13_ball_tree_clusters(spark, f"file://{tmp_path}/a").collect()
    assert {r.distance for r in rows} == {0} and {r.cluster for r in rows} == {0, 1, 2}
    frame(spark, []).write.parquet(f"file://{tmp_path}/b/embeddings.parquet")
    assert op13.op13_ball_tree_clusters(spark, f"file://{tmp_path}/b").collect() == []


def test_query_and_sql(spark, sf_dir):
    got = op13.op13_ball_tree_clusters(spark, sf_dir)
    assert same(got, op13.SQL, connect(sf_dir)) == common.table(spark, sf_dir, "embeddings").count()
    assert got.agg(F.sum("distance")).first()[0] == got.first().inertia

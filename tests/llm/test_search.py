import numpy as np
import pytest

from nothi.llm import op5_threshold_topk as op5
from nothi.llm import op9_hnsw as op9
from tests.compare import connect, same

E = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame(rows, E).selectExpr("*", "1 as score", "2 as rank", "'x' as shard", "array(1) as v")


def odd_rows():
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 440)] + [(40, [0.25] * 8)]
    return rows + [(1000, None), (1001, [None] + [0.1] * 7), (1002, [float("nan")] * 8), (1003, [float("inf")] + [0.1] * 7), (1004, []), (1005, [0.0] * 8), (1007, [1.0, 2.0]), (None, [0.1] * 8)]


def usable(rows, zero):
    return [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def brute(rows, every, k, zero, score, best_last):
    rows = usable([(i, [np.float32(x) if x is not None else None for x in v] if v else v) for i, v in rows], zero)
    out = {}
    for q in sorted({i for i, _ in rows if i % every == 0}):
        asks = min((v for i, v in rows if i == q), key=lambda v: v.tolist())
        found = [(score(asks, v), i) for i, v in rows if i != q and len(v) == len(asks)]
        out[q] = [(s, i) for s, i in sorted(found, key=lambda p: (-p[0] if best_last else p[0], p[1]))[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard, part", [(64, 8), (10_000, 10_000)])
def test_topk(spark, shard, part):
    rows = odd_rows()
    whole = lambda v: np.floor(64 * v)
    want = brute(rows, 20, 20, True, lambda a, b: int(whole(a) @ whole(b)), True)
    assert got(op5.search(frame(spark, rows), shard_rows=shard, query_rows=part)) == {q: v for q, v in want.items() if v}


def test_topk_against_sql(spark, sf_dir):
    assert same(op5.op5_threshold_topk(spark, sf_dir), op5.SQL, connect(sf_dir)) > 0


def test_threshold_stops_early():
    r = np.random.default_rng(0)
    rows = r.integers(-3, 4, (5000, 4))
    rows[7] = [90, 90, 90, 90]
    lists = op5.SortedLists.sort(np.arange(5000), rows)
    ids, scores = lists.top(-1, np.array([1.0, 1.0, 1.0, 1.0]), 1)
    assert ids.tolist() == [7] and scores.tolist() == [360]
    ids, _ = lists.top(-1, np.zeros(4), 3)
    assert ids.tolist() == [0, 1, 2]


@pytest.mark.parametrize("shard", [3, 1000])
def test_large_components_and_repeated_rows(spark, shard):
    big = [1e9, -3e9, 2.5e9, 7.0]
    rows = [(i, [x * (1 + i % 7) for x in big]) for i in range(60)] + [(20, [1e30, 0.0, 0.0, 0.0]), (61, [-1e30, 1.0, 1.0, 1.0]), (62, [1e30, 1.0, 1.0, 1.0])] + [(63, [1.0, 2.0, 3.0, 4.0])] * 30 + [(40, [0.5, 0.5, 0.5, 0.5])] * 25
    whole = lambda v: [int(max(-(2.0**62), min(2.0**62, np.floor(64 * x)))) for x in v]
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole(a.tolist()), whole(b.tolist())))))
    assert got(op5.search(frame(spark, rows), shard_rows=shard, query_rows=2)) == brute(rows, 20, 20, True, score, True)


def recall(found, want):
    return sum(len({i for _, i in want[q]} & {i for _, i in found.get(q, [])}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("shard", [64, 10_000])
def test_hnsw(spark, shard):
    rows = odd_rows()
    want = brute(rows, 20, 10, False, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    found = got(op9.search(frame(spark, rows), every=20, shard_rows=shard, query_rows=16))
    assert recall(found, want) >= 0.9
    by_id = {}
    for i, v in usable(rows, False):
        by_id.setdefault(i, []).append(np.float32(v).astype(float))
    for q, hits in found.items():
        asks = min(by_id[q], key=lambda v: v.tolist())
        assert len(hits) == len(want[q]) and hits == sorted(hits) and all(i != q for _, i in hits)
        assert all(any(abs(np.sqrt(((asks - v) ** 2).sum()) - s) < 1e-12 for v in by_id[i]) for s, i in hits)
    # Forty equal vectors: those with the smallest ids.
    assert [i for _, i in found[420]][:9] == list(range(400, 409))


def test_hnsw_recall_on_the_table(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    rows = list(zip(e.vec_id.tolist(), e.embedding.map(lambda v: [float(x) for x in v])))
    want = brute(rows, 100, 10, False, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    assert recall(got(op9.op9_hnsw(spark, sf_dir)), want) >= 0.9


def test_graph_is_connected_and_flat():
    x = np.random.default_rng(1).normal(0, 1, (700, 6)) + np.repeat(np.arange(7) * 100, 100)[:, None]
    g = op9.Graph(x)
    assert g.layers[0].shape == (700, 2 * op9.LINKS + 1) and all(a.dtype == np.int32 for a in g.layers) and g.layers[1].shape == (700, op9.LINKS)
    reached, front = {g.entry}, [g.entry]
    while front:
        front = [j for i in front for j in g.layers[0][i].tolist() if j >= 0 and j not in reached and not reached.add(j)]
    assert len(reached) == 700
    assert op9.Graph(x[:1]).search(x[:1], 5).tolist() == [[0]]


def test_recall_over_shards_and_hot_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0, 1, 24)]) for i in range(4000)] + [(i, [1.0] * 24) for i in range(4000, 6000)] + [(100, [2.0] * 24)] * 50
    want = brute(rows, 100, 10, False, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    found = got(op9.search(frame(spark, rows), shard_rows=800, query_rows=20))
    assert recall(found, want) >= 0.9 and all(len(found[q]) == 10 for q in want)
    # Of two thousand equal vectors the smallest ids.
    assert [i for _, i in found[5000]] == list(range(4000, 4010))


def test_empty(spark):
    for search in (op5.search, op9.search):
        assert search(frame(spark, [])).count() == 0 and search(frame(spark, [(20, [1.0])])).count() == 0

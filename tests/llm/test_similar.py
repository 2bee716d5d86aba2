"""The near-duplicate stage against plain five-word-shingle Jaccard."""

import random

import numpy as np

from nothi.llm import op4_simhash, shingle_join
from tests.llm.helpers import docs


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def partners(rows):
    """Index pairs of similarity 0.8 or more, by every comparison."""
    sets = [shingles(t) for _, t in rows]
    out = []
    for x, s in enumerate(sets):
        for y, o in enumerate(sets[:x]):
            if 5 * min(len(s), len(o)) >= 4 * max(len(s), len(o)):
                both = len(s & o)
                if 5 * both >= 4 * (len(s) + len(o) - both):
                    out.append((y, x))
    return out


def kept_by_force(rows):
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for y, x in partners(rows):
        a, b = top(x), top(y)
        label[max(a, b)] = min(a, b)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[top(x)] = min(i, least.get(top(x), i))
    return sorted(least.values())


def kept(spark, rows):
    return sorted(r.doc_id for r in op4_simhash.drop_near_duplicates(docs(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect())


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"c{rng.random()}"
    return out


def test_all_pairs_of_the_similarity_and_no_other(spark):
    rng, rows = random.Random(8), []
    for g in range(120):
        base = [f"w{rng.randrange(100_000)}" for _ in range(rng.choice([5, 8, 9, 30, 200, 400]))]
        rows.append(base)
        # Each changed word takes five shingles away, so these lie on both sides of 0.8.
        rows += [changed(rng, base, round(len(base) * rng.choice([0.015, 0.02, 0.022, 0.025, 0.03]))) for _ in range(2)]
        rows.append(base + [f"e{rng.random()}" for _ in range(max(1, len(base) // 4))])
    texts = [" ".join(r) for r in rows] + ["", "  \t"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    assert kept(spark, rows) == kept_by_force(rows)


def test_families_that_share_a_passage(spark, monkeypatch):
    """Many groups of near copies around one passage: every list is long, and most of its members are not similar."""
    rng, rows = random.Random(9), []
    passage = [f"p{i}" for i in range(120)]
    for g in range(40):
        base = passage + [f"g{rng.randrange(10**6)}" for _ in range(60)]
        rows += [changed(rng, base, rng.choice([1, 2, 3, 4])) for _ in range(5)]
    rows = list(enumerate(" ".join(r) for r in rows))
    want = kept_by_force(rows)
    assert kept(spark, rows) == want and 40 <= len(want) < 200
    # The same by blocks.
    monkeypatch.setattr(shingle_join, "BLOCK", 16)
    monkeypatch.setattr(shingle_join, "PARTNERS", 1)
    assert kept(spark, rows) == want


def test_a_large_family_and_those_that_just_miss_it(spark, monkeypatch):
    """One component of several blocks; the rest has 0.7 to 0.8 with it."""
    monkeypatch.setattr(shingle_join, "BLOCK", 32)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(160)]
    rows = [changed(rng, base, n) for n in [0, 1, 1, 2] * 40 + [3, 4, 5, 6, 7] * 25]
    rows = list(enumerate(" ".join(r) for r in rows))
    want = kept_by_force(rows)
    assert kept(spark, rows) == want and 2 <= len(want) < 100


def test_short_texts(spark):
    """Eight and nine words: four shingles of five, the least that 0.8 allows to differ."""
    rng, rows = random.Random(11), []
    for g in range(150):
        base = [f"s{rng.randrange(10**6)}" for _ in range(8)]
        rows += [base, base + [f"t{g}"], [f"u{g}", *base], changed(rng, base, 1)]
    rows = list(enumerate(" ".join(r) for r in rows))
    assert kept(spark, rows) == kept_by_force(rows)


def test_the_sketch_keeps_similar_sets_of_any_size():
    r, dropped = np.random.default_rng(2), 0
    new = lambda n: r.integers(0, 1 << 64, n, dtype=np.uint64)
    for common_, one, two in [(4, 1, 0), (4, 0, 0), (8, 1, 1), (40, 5, 5), (400, 50, 50), (4000, 500, 500)] * 150:
        both = new(common_)
        x, y = (np.unique(np.concatenate([both, new(n)])) for n in (one, two))
        a, b = (np.frombuffer(shingle_join.sketch_of(v), np.uint8) for v in (x, y))
        assert shingle_join.alike(x, y) and shingle_join.promising(a, b[None])[0] >= 0
        near, far = (set(np.frombuffer(shingle_join.cells_of(v), "<u2").tolist()) for v in (x, y))
        assert not near or not far or 9 * sum(c in near for c in np.frombuffer(shingle_join.cells_of(y), "<u2").tolist()) >= 4 * (len(x) + len(y))
        z = np.frombuffer(shingle_join.sketch_of(np.sort(np.concatenate([both[: common_ // 2], new(common_)]))), np.uint8)
        dropped += shingle_join.promising(a, z[None])[0] < 0
    assert dropped >= 290
    assert not shingle_join.FEWEST[:12].any() and shingle_join.FEWEST[128] >= 60


def test_similar_sets_have_near_fingerprints():
    r = np.random.default_rng(1)
    far = []
    for n in [9] * 300 + [45] * 300 + [450] * 300:
        both = r.integers(0, 1 << 63, n * 8 // 9).astype("<u8")
        x, y = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, n - len(both)).astype("<u8")])) for _ in range(2))
        assert shingle_join.alike(x, y)
        far.append((shingle_join.simhash(x) ^ shingle_join.simhash(y)) % (1 << 64))
    assert max(bin(f).count("1") for f in far) <= shingle_join.FAR


def test_fingerprints_and_pivots_give_links(spark):
    nodes = spark.createDataFrame([(0, 5), (1, 5), (2, 4), (3, -1), (4, -4), (5, 7 << 40)], "node long, f long")
    assert sorted(map(tuple, shingle_join.print_pairs(nodes).collect())) == [(0, 1), (0, 2), (3, 4)]


def test_a_component_is_dealt_out_once_for_all_lists(spark):
    """A component of 150 in forty lists that have different members: what is dealt out follows the members, not the lists."""
    members = [(key, node) for key in range(40) for node in range(190) if node != 160 + key % 30]
    lists = spark.createDataFrame(members, "key long, node long")
    nodes = spark.createDataFrame([(n, 20, bytearray(32), bytearray(), bytearray()) for n in range(190)], "node long, n int, bits binary, sketch binary, cells binary")
    labels = spark.createDataFrame([(n, 0) for n in range(150)], "id long, label long")
    rows = shingle_join.open_rows(lists, nodes, labels)
    assert rows.filter("key is null").count() == 190 and rows.count() <= 190 + 30 * 40
    pairs = {tuple(p) for p in shingle_join.unconnected_pairs(rows).collect()}
    # No list lacks both of two others, so all pairs with one outside meet.
    assert pairs == {(a, b) for b in range(150, 190) for a in range(b)}


def test_the_bitmaps_keep_similar_sets_of_any_size():
    r = np.random.default_rng(3)
    for n, one, two in [(8, 1, 1), (80, 10, 10), (800, 100, 100), (800, 200, 0), (8000, 1000, 1000)] * 40:
        both = r.integers(0, 1 << 64, n, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, r.integers(0, 1 << 64, k, dtype=np.uint64)])) for k in (one, two))
        z = np.unique(np.concatenate([both[: n // 2], r.integers(0, 1 << 64, n, dtype=np.uint64)]))
        bits = shingle_join.Bitmaps([shingle_join.parity_of(v) for v in (x, y, z)])
        near, far = bits.differ(0, np.array([1, 2]))
        assert shingle_join.alike(x, y) and near <= len(np.setxor1d(x, y)) and 9 * near <= len(x) + len(y)
        assert n not in (80, 800) or 9 * far > len(x) + len(z)


def test_only_rows_of_repeated_sets_meet_others(spark):
    rows = [(i, 7, 0, i % 40, 0, 100 + i, [i]) for i in range(50)]
    found = shingle_join.numbered(spark.createDataFrame(rows, "id long, h0 long, h1 long, d0 long, d1 long, row long, keys array<long>"))
    assert {r.id: (r.node, r["keys"]) for r in found.collect()} == {i: (100 + i % 40, [i]) for i in range(50)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The lists of shingles pass no aggregate, and those of the other rows no join.
    assert "Aggregate" not in plan and plan.count("Join ") == 1 and plan.count("Union") == 1


def test_repeated_rows_of_similar_texts(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (1, base), (1, base), (2, base + " x"), (2, base + " x"), (3, base + " y"), (4, "w0 w1"), (4, "w0 w1")]
    stay = op4_simhash.drop_near_duplicates(docs(spark, [(i, t, "en", "a", 0) for i, t in rows], extra=False)).collect()
    assert sorted((r.doc_id, r.text) for r in stay) == [(1, base), (4, "w0 w1")]


def test_two_similar_texts_with_far_fingerprints(spark):
    """Nobody else has their shingles, and 27 bits part their fingerprints."""
    base = " ".join(f"s8604a{i}" for i in range(8))
    one, two = (shingle_join.shingle_set(t.encode()) for t in (base, base + " u"))
    assert shingle_join.alike(one, two) and bin((shingle_join.simhash(one) ^ shingle_join.simhash(two)) % (1 << 64)).count("1") > shingle_join.FAR
    assert kept(spark, [(1, base), (2, base + " u")]) == [1]


def test_no_similar_pair_hangs_on_the_sketch(spark):
    """A large set and the same without the smallest hash of each range: they agree in few ranges and are similar."""
    x = np.unique(np.random.default_rng(4).integers(0, 1 << 64, 6000, dtype=np.uint64))
    at = np.flatnonzero(np.diff((x >> np.uint64(57)).astype(np.int64), prepend=-1))
    y = np.delete(x, at)
    a, b = (np.frombuffer(shingle_join.sketch_of(v), np.uint8) for v in (x, y))
    assert shingle_join.alike(x, y) and shingle_join.promising(a, b[None])[0] < 0
    rows = [(7, None, 0, 0, True, k, k, len(v), bytearray(shingle_join.parity_of(v)), bytearray(shingle_join.sketch_of(v)), bytearray()) for k, v in enumerate([x, y])]
    rows = spark.createDataFrame(rows, "key long, of long, i int, j int, first boolean, node long, label long, n int, bits binary, sketch binary, cells binary")
    assert [tuple(p) for p in shingle_join.unconnected_pairs(rows).collect()] == [(0, 1)]


def test_every_document_counts_for_commonness(spark):
    texts = [f"one two three four five{i % 3}" for i in range(30)]
    counts = shingle_join.sketch(docs(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).value
    assert counts.sum() == 30 and sorted(counts[counts > 0].tolist()) == [10, 10, 10]

import random

import numpy as np
import pytest

from nothi.llm import common, graph, op2_warc_revisit, op4_simhash
from tests.compare import connect, same
from tests.llm.helpers import LONG, docs, empty

PAGES = "page_id long, url string, html string"
BIG = "<p>" + "payload " * 20
PAGE_ROWS = [(4, "http://a/1", BIG), (2, None, BIG), (9, "http://a/\r\nX-Page: 77", BIG), (2, None, BIG), (None, "u", BIG), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (1, "ü", "é" * 49 + "x"), (3, "v", "é" * 49 + "x"), (10, "v", "é" * 50), (11, "v", "é" * 50), (12, "w", LONG)]


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as digest", "1 as first", "2 as n", "'k' as key", "'p' as payload")


def test_warc(spark):
    out = op2_warc_revisit.read_archives(op2_warc_revisit.write_archives(pages(spark, PAGE_ROWS), common.scratch_path(spark, "w"), roll=2000)).collect()
    assert len(out) == len(PAGE_ROWS)
    found = sorted(((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in out), key=repr)
    big, want = len(BIG), []
    first = {big: 2, 100: 10}
    for page_id, _, html in PAGE_ROWS:
        n = len((html or "").encode())
        again = n in first and page_id is not None and page_id > first[n] and n >= 100
        want.append((page_id is not None, page_id or 0, n, "revisit" if again else "response", first[n] if again else None))
    assert found == sorted(want, key=repr)


def test_warc_hot_digest(spark):
    rows = [(i, "u", BIG if i % 3 else BIG + str(i)) for i in range(300)]
    out = op2_warc_revisit.read_archives(op2_warc_revisit.write_archives(pages(spark, rows), common.scratch_path(spark, "w"))).collect()
    assert sum(r.record_type == "revisit" for r in out) == 199 and {r.refers_to for r in out} == {None, 1}


def test_warc_shuffled_join_and_headers(spark, monkeypatch):
    monkeypatch.setattr(op2_warc_revisit, "HOT", 1)  # no digest is hot
    rows = [(i, f"u{i}", BIG + str(i % 40)) for i in range(300)] + [(i, "v", "short") for i in range(300, 340)] + [(7, "other", BIG + "x"), (None, "n", BIG), (None, "n", BIG)]
    archives = op2_warc_revisit.write_archives(pages(spark, rows), common.scratch_path(spark, "w"), date="2030-05-06T07:08:09Z")
    out = op2_warc_revisit.read_archives(archives).collect()
    want = sorted([(i, "revisit", i % 40) if i >= 40 else (i, "response", None) for i in range(300)] + [(i, "response", None) for i in range(300, 340)] + [(7, "response", None)], key=repr)
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in out if r.page_id is not None), key=repr) == want
    headers = []
    for a in archives.collect():
        with open(a.path.removeprefix("file:"), "rb") as f:
            headers += [h for h, _ in op2_warc_revisit.read_records(f)]
    assert {h["WARC-Date"] for h in headers} == {"2030-05-06T07:08:09Z"}
    ids = {h["WARC-Record-ID"] for h in headers}
    # The two equal rows are one record.
    assert len(ids) == len(rows) - 1 and {h["WARC-Refers-To"] for h in headers if "WARC-Refers-To" in h} <= ids


def test_warc_sql_and_empty(spark, sf_dir):
    assert same(op2_warc_revisit.op2_warc_revisit(spark, sf_dir), op2_warc_revisit.SQL, connect(sf_dir)) > 0
    assert op2_warc_revisit.read_archives(op2_warc_revisit.write_archives(pages(spark, []), common.scratch_path(spark, "w"))).count() == 0


def brute_components(rows):
    prints = [(i, op4_simhash.fingerprint((t or "").encode())[0]) for i, t in rows]
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(prints)):
        for y in range(x):
            if None not in (prints[x][0], prints[y][0]) and bin(prints[x][1] ^ prints[y][1]).count("1") <= 2:
                parent[top(x)] = top(y)
    groups = {}
    for x, (i, _) in enumerate(prints):
        if i is not None:
            groups.setdefault(top(x), []).append(i)
    return prints, {f: min(groups[top(x)]) for x, (i, f) in enumerate(prints) if i is not None}


def check_components(spark, rows):
    df = docs(spark, [(i, t, None, None, None) for i, t in rows])
    prints, component = brute_components(rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.f0 % (1 << 64), r.component_id) for r in op4_simhash.components(df).collect()), key=repr)
    assert got == sorted(((i is not None, i or 0, f, component.get(f)) for i, f in prints), key=repr)


def test_fingerprint_by_hand():
    import xxhash

    words = "a b c a b c".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), seed=42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2)
    assert op4_simhash.fingerprint(b"A  b\tc a\x0bB\nc") == [want]
    assert op4_simhash.fingerprint("Ä b".encode()) == [xxhash.xxh64_intdigest("Ä b", seed=42)]
    assert op4_simhash.fingerprint(b" \t") == [0]


@pytest.mark.parametrize("words, planes", [(3, 1), (5, 4)])
def test_long_texts_in_parts(monkeypatch, words, planes):
    random.seed(4)
    texts = [" ".join(random.choices(["a", "Bc", "d\t", "efg\n ", "é"], k=n)).encode() for n in (0, 1, 2, 3, 4, 5, 6, 50, 400)]
    whole = [op4_simhash.fingerprint(t, words, planes) for t in texts]
    for size in (1, 3, 17):
        monkeypatch.setattr(op4_simhash, "LONG", size)
        assert [op4_simhash.fingerprint(t, words, planes) for t in texts] == whole


def test_components(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(50)]
    rows = [(None, "w1 w2 w3 w4"), (8, "w1 w2 w3 w4"), (3, None), (2, ""), (1, " "), (1, " "), (70, LONG), (60, LONG)]
    for g in range(20):
        base = random.choices(words, k=120)
        for _ in range(random.randint(1, 6)):
            text = list(base)
            for _ in range(random.randint(0, 2)):
                text[random.randrange(120)] = random.choice(words)
            rows.append((100 + len(rows), " ".join(text)))
    check_components(spark, rows)


@pytest.mark.parametrize("most", [64, 2])
def test_near_pairs_lose_nothing(spark, most):
    r = np.random.default_rng(2)
    centre = int(r.integers(0, 1 << 63))
    prints = {centre} | {centre ^ 1 << int(a) ^ 1 << int(b) for a, b in r.integers(0, 64, (150, 2))} | {int(x) for x in r.integers(0, 1 << 63, 200)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)], "rep long, f0 long")
    want = {(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and bin(a ^ b).count("1") <= 2}
    assert {tuple(p) for p in op4_simhash.near_pairs(nodes, most).collect()} == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (150, 300)]
    random.Random(1).shuffle(edges)
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 150, 200, 300)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    random.seed(3)
    words = [f"v{i}" for i in range(3000)]
    base = [" ".join(random.choices(words, k=150)) for _ in range(30)]
    near = base[0].split()
    near[70] = "changed"
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(base)] + [(50, " ".join(near), "en", "s", 0), (51, base[1].upper(), "en", "s", 0), (52, base[2], "en", "s", 0), (None, base[3], "en", "s", 0), (4, base[4], "en", "s", 0)]
    df = docs(spark, rows)
    out = op4_simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, i) for i in range(30)]


def test_stage_judges_rows_and_not_ids(spark):
    random.seed(4)
    a, b, c, d = (" ".join(random.choices([f"u{i}" for i in range(3000)], k=90)) for _ in range(4))
    rows = [(1, a), (50, a), (50, b), (60, b + " more"), (70, c), (70, d), (70, d), (None, c), (None, None), (80, ""), (None, a + " " + d)]
    out = op4_simhash.drop_near_duplicates(docs(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in out), key=repr) == sorted([(1, a), (50, b), (70, c), (70, d), (80, ""), (0, a + " " + d)], key=repr)


def test_pivots_discard(spark):
    r = np.random.default_rng(4)
    block = int(r.integers(0, 1 << 32))
    prints = sorted({block << 32 | int(x) for x in r.integers(0, 1 << 32, 60)} | {block << 32 | 5 | 1 << k for k in range(4)})
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)], "rep long, f0 long")
    n = op4_simhash.pivot_report(nodes).head()
    assert n.keyed > n.celled > n.allowed >= n.near > 0


def test_empty(spark):
    assert op4_simhash.components(empty(spark)).count() == 0 and op4_simhash.drop_near_duplicates(empty(spark)).count() == 0

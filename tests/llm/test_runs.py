import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from nothi.llm import common
from nothi.llm import op12_periodic_runs as op12
from tests.llm.helpers import ROWS, docs, empty


def brute(w):
    """Every stretch, with its smallest period, that no neighbour extends."""
    n, out = len(w), []
    for s in range(n):
        for t in range(s + 6, n + 1):
            q = next(q for q in range(1, t - s + 1) if all(w[i] == w[i + q] for i in range(s, t - q)))
            if t - s >= max(6, 4 * q) and (s == 0 or w[s - 1] != w[s - 1 + q]) and (t == n or w[t] != w[t - q]):
                out.append((s, t - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_words(w):
    """The same, one lag and one word after the other."""
    n, seen, out = len(w), set(), []
    for q in range(1, n // 4 + 1):
        s = None
        for i in range(n - q + 1):
            same = i < n - q and w[i] == w[i + q]
            if same and s is None:
                s = i
            if not same and s is not None:
                if i - s + q >= max(6, 4 * q) and (s, i) not in seen and not any(a == s and a + m == i + q for a, m, _ in out):
                    out.append((s, i - s + q, q))
                s = None
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_against_every_stretch(seed):
    rng = random.Random(seed)
    for i in range(120):
        n, k = rng.randint(0, 32), rng.choice([1, 2, 3, 5])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        if i % 2 and n:
            a, p = rng.randrange(n), rng.randint(1, 5)
            w = [w[j] if j < a or a + (j - a) % p >= n else w[a + (j - a) % p] for j in range(n)]
        assert op12.runs_of(op12.numbered(w)) == brute(w)


def test_one_run_in_another():
    w = (b"a a a a a a a b".split() * 4) + [b"c"]
    assert op12.runs_of(op12.numbered(w)) == brute(w)
    assert [r[2] for r in op12.runs_of(op12.numbered(w))] == [1, 8, 1, 1, 1]


def test_kept_words():
    w = b"x a b a b a b a b y".split()
    assert op12.kept_words(w, op12.runs_of(op12.numbered(w))) == b"x a b y".split()


def test_many_words_and_planes():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3000, 6000)
    for at, p, m in ((10, 7, 40), (500, 300, 1300), (3000, 1, 6), (3600, 2, 7)):
        w[at : at + m] = np.resize(w[at : at + p], m)
    assert op12.runs_of(w) == by_words(w.tolist())


def test_a_very_long_text_of_one_word():
    assert op12.runs_of(np.zeros(20_000, np.int64)) == [(0, 20_000, 1)]


def planted(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = by_words(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_on_whole_tables(spark, sf_dir):
    rows = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op12.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows) and any(r[1] for r in got.values())
    for r in rows:
        # The plain version takes a comparison for each word and lag.
        if len(r.text or "") < 6000:
            assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_odd_rows(spark, tmp_path):
    rows = ROWS + [(d, "w x y z " * 9, "en", "a", 0) for d in range(100, 140)] + [(11, "a\x85a a\x85a a\x0ba a a a a", "en", "a", 0)]
    docs(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op12.op12_periodic_runs(spark, f"file://{tmp_path}").collect()
    key = lambda p: (p[0] is not None, p[0] or 0, p[6])
    short = [r for r in rows if r[0] != 9]
    assert sorted((tuple(r) for r in got if r.doc_id != 9), key=key) == sorted((expected(r[0], r[1]) for r in short), key=key)
    (long,) = [r for r in got if r.doc_id == 9]
    assert long.n_runs >= 1 and long.length > 10_000
    assert op12.periodic_runs(empty(spark)).collect() == []

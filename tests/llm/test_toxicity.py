import random
import zlib

import numpy as np
import pytest

from nothi.llm import op7_toxicity as op7
from tests.llm.helpers import docs, empty

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, seed=1):
    """Invented prose; a tenth has two or three words of an invented list among its own."""
    r = random.Random(seed)
    parts = [a + b for a in "ba de li mo nu ra se ti".split() for b in ("n", "r", "", "st")]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    bad = ["gruxok", "vlaquzz", "hykkpog", "zworxen"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randint(20, 120))], int(i % 10 == 0)
        for _ in range(r.randint(2, 3) * toxic):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    return rows, labels, {r.doc_id: r for r in op7.classify(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}


def test_held_out_rows(scored):
    rows, labels, out = scored
    held = [(out[i].predicted, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 150 and all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())


def test_filter_keeps_columns_and_clean_rows(spark):
    rows, labels = corpus(400)
    df = docs(spark, rows)
    kept = op7.drop_toxic(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids & {i for i, _, t in labels if not t}) >= 0.98 * 360 and len(ids & {i for i, _, t in labels if t}) <= 6


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(200)
    d = docs(spark, rows)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (op7.train(d, spark.createDataFrame(x, LABELS)) for x in (labels, other))
    assert (a.ordinary, a.toxic, a.thresholds, a.weights) == (b.ordinary, b.toxic, b.thresholds, b.weights)


def test_odd_rows(spark):
    rows, labels = corpus(200)
    out = op7.classify(docs(spark, rows[:150]).unionByName(docs(spark, [(i + 5000 if i is not None else None, t, None, None, None) for i, t, *_ in __import__("tests.llm.helpers", fromlist=["x"]).ROWS])), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], LABELS)).collect()
    assert len(out) == 159 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (5003, 5007, 5004)}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [False]


def test_empty(spark):
    rows, labels = corpus(60)
    none = spark.createDataFrame([], LABELS)
    assert op7.classify(empty(spark), none).count() == 0 and op7.classify(empty(spark), spark.createDataFrame(labels, LABELS)).count() == 0
    assert {r.score for r in op7.classify(docs(spark, rows), none).collect()} == {0.0}
    assert op7.drop_toxic(docs(spark, rows), none).count() == 60


def test_gain_is_of_compressed_lengths():
    rows, labels = corpus(600, seed=3)
    texts = [(r[1], t) for r, (_, _, t) in zip(rows, labels)]
    ordinary, toxic = op7.dictionaries([x for x, t in texts if t], [x for x, t in texts if not t])
    assert ordinary[:4] == toxic[:4] == b"\x37\xa4\x30\xec"  # both are trained
    d = op7.Distance(ordinary, toxic)
    gain = lambda text: d.gains(op7.Windows([text])).tolist()
    assert gain(b"banba gruxok limo") > [2] and max(gain(b"banba dest limo muras")) <= 1
    assert gain(b"") == [] and op7.features(np.zeros((1, op7.MOST), int), [2, 3, 5]).tolist() == [[0.0] * 9]


def test_windows():
    made = op7.Windows([b"one two  three\n\n, four", b"", b" \t ", b"a b", b"x" * 100 + b" y"])
    x = b"x" * 48
    assert made.list() == [b" one two three ", b" two three , ", b" three , four ", b" a b ", b" " + x + x + b"xxxx ", x[:1] + x + b"xxxx y "]
    assert made.of.tolist() == [0, 0, 0, 3, 4, 4] and made.texts == 5


def test_thresholds_are_calibrated():
    counts = np.zeros((1, op7.MOST), int)
    counts[0, [0, 1, 2, 3, 5]] = 100_000, 2_000, 500, 80, 5
    assert op7.calibrated(counts) == [2, 3, 4]
    assert op7.calibrated(np.zeros((1, op7.MOST), int)) == [1, 2, 3]


def test_long_texts_in_parts(monkeypatch):
    d = op7.Distance(b"plain words and other ones", b" gruxok ")
    text = "plain gruxok, other " * 40
    whole = d.counts([text, "a", text])
    monkeypatch.setattr(op7, "TOGETHER", 64)
    assert d.counts([text, "a", text]).tolist() == whole.tolist() and whole.sum() == 118 * 2 + 1 and d.counts(["." * 300]).sum() >= 1


def test_planted_rows_of_the_tables(spark):
    """Held-out rows of sf0.1: those that hold a word of the marked documents are found, others are left alone."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    held = read("documents").join(read("labels").select("doc_id", "toxic"), "doc_id").filter(op7.held_out(op7.F.col("doc_id")))
    out = held.select("text", "toxic", op7.score_column(op7.train(read("documents"), read("labels")), spark).alias("score")).collect()
    marked = [r.score >= 0.3 for r in out if r.toxic and any(w in r.text for w in ("idiot", "moron", "scum", "trash", "clown", "loser", "stupid", "worthless", "pathetic", "disgusting"))]
    clean = [r.score >= 0.3 for r in out if r.toxic == 0]
    assert len(marked) > 50 and sum(marked) >= 0.9 * len(marked) and sum(clean) <= 0.01 * len(clean)

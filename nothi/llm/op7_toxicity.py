"""Toxicity by compression distance: zstandard dictionaries trained on ordinary and on toxic text.

A text is lower-cased and cut into overlapping windows of three words with what stands between and around them (words of more than
48 bytes count as several). Each window is compressed with the ordinary dictionary and with the ordinary one plus the toxic one;
the bytes that the toxic one saves are the window's gain. Both dictionaries end in the same tail, which closes every window: zstandard looks for no
match in the last bytes of its input and stores incompressible input raw, and the tail takes both effects out of the difference.

The library trains both dictionaries on windows. Labels say which documents are toxic, not which passages. So the toxic dictionary
is trained on the windows of toxic documents that hold a word which is much more frequent there than in ordinary ones. The ordinary dictionary is trained on ordinary
windows; then, in rounds, the ordinary windows in which the toxic dictionary still gains are added to it.

Gains are counted against three thresholds, which a hundredth, a thousandth and a ten-thousandth of ordinary windows reach. A logistic
function of these counts and the three highest gains is the document's score. Thresholds and weights are fitted to gains
from dictionaries that have not seen the document (two halves score each other), so the score is calibrated.

Fitting takes at most ``TOXIC`` and ``ORDINARY`` labelled rows by the checksum of the doc_id, at most ``FIT_CHARS`` characters of each
kind in all (a text that does not fit whole is left out), none of the held-out rows, and leaves out near copies among them. Of labelled rows that repeat a
doc_id the smallest text counts, and it is toxic if any label says so. Scoring takes every row and whole texts, long ones
in parts. Labels, language, source and doc_id are no part of a score.

Null and empty texts have no window and score as a text without gain. Without both kinds of labels every score is zero. Rows with a null doc_id
are not held out and not fitted to. Repeated rows score alike. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.llm import common

TOXIC, ORDINARY, FIT_CHARS, THRESHOLD = 1500, 4000, 32_000_000, 0.3
WORDS, WORD_BYTES, LEVEL = 3, 48, 3
ORDINARY_BYTES, TOXIC_BYTES, ADDED_BYTES, SAMPLES = 128 << 10, 2 << 10, 256 << 10, 120_000
#: Rounds of adding ordinary windows, and the gain from which they are added.
ROUNDS, ADDED_GAIN = 4, 2
#: Shares of ordinary windows that reach the thresholds.
SHARES = (1e-2, 1e-3, 1e-4)
#: Gains from here on count alike.
MOST = 16
#: Segments and samples have a size that suits words.
SEGMENT = {"k": 16, "d": 6}
TAIL = b"#0123456789abcd;"
#: Bytes of text whose windows are laid out at once.
TOGETHER = 1 << 17
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Windows:
    """The windows of some texts, laid end to end, each with the tail."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n\n".join([b"", *texts, b""]), np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        starts = np.cumsum([1, *(len(t) + 2 for t in texts)])
        first, last = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        pieces = (last - first + WORD_BYTES - 1) // WORD_BYTES
        if len(first) and pieces.max() > 1:
            at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, last = np.repeat(first, pieces) + at * WORD_BYTES, np.minimum(np.repeat(first, pieces) + (at + 1) * WORD_BYTES, np.repeat(last, pieces))
        of = np.searchsorted(starts, first, side="right") - 1
        final = np.searchsorted(of, of, side="right") - 1
        end = np.arange(len(first)) + WORDS - 1
        opens = np.ones(len(first), bool)
        opens[1:] = of[1:] != of[:-1]
        kept = (end <= final) | opens
        self.of, self.texts = of[kept], len(texts)
        # Runs of white space count as one space.
        drop = np.zeros(len(raw), bool)
        drop[1:] = space[1:] & space[:-1]
        before = np.cumsum(drop) - drop
        a, e = first[kept], last[np.minimum(end, final)[kept]]
        a, e = a - before[a] - 1, e - before[e] + 1
        flat = np.where(space, np.uint8(32), raw)[~drop]
        size = e - a
        whole = size + len(TAIL)
        self.at, self.size = np.cumsum(whole) - whole, size
        total = int(whole.sum())
        take = np.arange(total) + np.repeat(a - self.at, whole)
        self.data = np.take(flat, take, mode="clip")
        self.data[((self.at + size)[:, None] + np.arange(len(TAIL))).ravel()] = np.tile(np.frombuffer(TAIL, np.uint8), len(size))
        self.segments = np.column_stack([self.at, whole]).astype(np.uint64)

    def list(self) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a : a + n] for a, n in zip(self.at.tolist(), self.size.tolist())]


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode()


def laid_out(texts: list[bytes]):
    """(number of the first text, windows) in groups of bounded size; a long text is several groups that overlap by two words."""
    group, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if len(t) > 2 * TOGETHER:
            if group:
                yield begin, Windows(group)
            at = 0
            while at < len(t):
                end = at + TOGETHER
                cut = re.compile(rb"\s").search(t, end) if end < len(t) else None
                end = cut.start() if cut else len(t)
                yield i, Windows([t[at:end]])
                back = re.search(rb"(\S{1,%d}\s+\S{1,%d})\s*\Z" % (WORD_BYTES, WORD_BYTES), t[max(at, end - 4 * WORD_BYTES) : end])
                at = end if end == len(t) else end - (len(back[0]) if back and len(back[0]) < TOGETHER // 2 else 0)
            group, begin, size = [], i + 1, 0
            continue
        group.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield begin, Windows(group)
            group, begin, size = [], i + 1, 0
    if group:
        yield begin, Windows(group)


class Distance:
    """The gain of windows under one pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as zs

        self.buffer = zs.BufferWithSegments
        self.pair = []
        for content in (ordinary + TAIL, ordinary + toxic + TAIL):
            fitted = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), write_checksum=False, write_content_size=False, write_dict_id=False)
            held = zs.ZstdCompressionDict(content)
            held.precompute_compress(compression_params=fitted)
            self.pair.append(zs.ZstdCompressor(compression_params=fitted, dict_data=held))

    def gains(self, windows: Windows) -> np.ndarray:
        if not len(windows.at):
            return np.zeros(0, np.int64)
        data, segments, lengths = windows.data.tobytes(), windows.segments.tobytes(), []
        for c in self.pair:
            out = c.multi_compress_to_buffer(self.buffer(data, segments), threads=1)
            lengths.append(np.fromiter((len(out[k]) for k in range(len(out))), np.int64, len(out)))
        return lengths[0] - lengths[1]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """For each text, how many windows have each gain from 0 to MOST - 1."""
        total = np.zeros((len(texts), MOST), np.int64)
        for begin, w in laid_out([folded(t) for t in texts]):
            cell = w.of * MOST + self.gains(w).clip(0, MOST - 1)
            total[begin : begin + w.texts] += np.bincount(cell, minlength=w.texts * MOST).reshape(-1, MOST)
        return total


def features(counts: np.ndarray, thresholds: list[int]) -> np.ndarray:
    """The three highest gains, and the number and the share of windows at each threshold."""
    reached = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    top = [(reached[:, 1:] >= n).sum(axis=1) for n in (1, 2, 3)]
    n = np.maximum(20, reached[:, 0])
    at = [reached[:, t] for t in thresholds]
    return np.column_stack([*top, *map(np.log1p, at), *(np.sqrt(x / n) for x in at)]).astype(float)


def calibrated(counts: np.ndarray) -> list[int]:
    """The gains that the given shares of windows reach at most; each above the one before."""
    reached = counts.sum(axis=0)[::-1].cumsum()[::-1]
    out = [0]
    for share in SHARES:
        out.append(min(MOST - 1, max(out[-1] + 1, int((reached > share * max(1, reached[0])).sum()))))
    return out[1:]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that the library trains; of too few samples for that, the samples."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, level=LEVEL, **SEGMENT).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""

    def in_documents(texts: list[str]) -> Counter:
        found: Counter = Counter()
        for t in texts:
            found.update(set(_WORD.findall(t.lower())))
        return found

    def some(found: list[bytes]) -> list[bytes]:
        return [found[i] for i in np.random.default_rng(1).permutation(len(found))[:SAMPLES]]

    t, o = in_documents(toxic), in_documents(ordinary)
    telling = {w for w, n in t.items() if n >= max(3, 0.005 * len(toxic)) and n / len(toxic) >= 20 * (o[w] + 0.5) / len(ordinary)}
    passages = [x for _, w in laid_out([folded(x) for x in toxic]) for x in w.list() if not telling.isdisjoint(_WORD.findall(x.decode(errors="replace")))]
    plain = [x for _, w in laid_out([folded(x) for x in ordinary]) for x in w.list()[::WORDS]]
    base, added = trained(some(plain), ORDINARY_BYTES), []
    if not passages:
        return base, b""
    tail = trained(some(passages), TOXIC_BYTES)
    content = base
    for r in range(ROUNDS):
        distance = Distance(content, tail)
        for _, w in laid_out([folded(x) for x in ordinary[r::ROUNDS]]):
            high, data = np.flatnonzero(distance.gains(w) >= ADDED_GAIN), w.data.tobytes()
            added += [data[a : a + n] for a, n in zip(w.at[high].tolist(), w.size[high].tolist())]
        content = base + b"".join(dict.fromkeys(added))[-ADDED_BYTES:]
    return content, tail


def independent(texts: list[str]) -> list[int]:
    """Numbers of the texts that share less than half of their five-word runs with those before."""
    seen: set[int] = set()
    out = []
    for i, text in enumerate(texts):
        words = text.split()
        runs = {h for k in range(max(1, len(words) - 4)) if (h := zlib.crc32(" ".join(words[k : k + 5]).encode())) % 4 == 0}
        if not runs or len(runs & seen) < 0.5 * len(runs):
            out.append(i)
        seen |= runs
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an intercept first (Newton's method)."""
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.diag([1e-6] + [1e-2] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, ordinary: bytes = b"", toxic: bytes = b"", thresholds: list[int] = (), weights: list[float] = ()):
        self.ordinary, self.toxic, self.thresholds, self.weights = ordinary, toxic, list(thresholds), list(weights)

    def score(self, texts, distance: Distance) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(texts))
        x = features(distance.counts(texts), self.thresholds)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, half: the bounded sample that everything is fitted to."""
    rows = common.pick(labels, doc_id="long", toxic="int").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    take = lambda y, n: rows.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(n)
    # At most TOXIC + ORDINARY rows of two numbers.
    chosen = take(1, TOXIC).union(take(0, ORDINARY))
    texts = common.pick(docs, doc_id="long", text="string").filter("text is not null").join(F.broadcast(chosen), "doc_id").select(order.alias("h"), "doc_id", "text", "toxic")
    schema = pa.schema([("text", pa.string()), ("toxic", pa.int32()), ("half", pa.int32())])

    def choose(batches):
        room, kept, last = {0: FIT_CHARS, 1: FIT_CHARS}, {0: [], 1: []}, None
        for b in common.freeing(batches, "toxicity"):
            for doc_id, text, toxic in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                if doc_id != last and len(text) <= room[toxic]:
                    room[toxic] -= len(text)
                    kept[toxic].append(text)
                last = doc_id
        for toxic, texts in kept.items():
            texts = [texts[i] for i in independent(texts)]
            for at in range(0, len(texts), 64):
                part = texts[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic] * len(part), pa.int32()), pa.array([(at + k) % 2 for k in range(len(part))], pa.int32())], schema=schema)

    # The sample is bounded in rows and characters, so one task can look for near copies in it.
    return common.materialize(texts.repartition(1).sortWithinPartitions("h", "doc_id", "text").mapInArrow(choose, "text string, toxic int, half int"), "labelled")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample: three pairs of dictionaries in three tasks (each half, and all), then thresholds and weights on the driver."""
    sample = labelled(docs, labels)
    schema = pa.schema([("side", pa.int32()), ("ordinary", pa.binary()), ("toxic", pa.binary())])

    def make(t: pa.Table) -> pa.Table:
        common.keep_only("toxicity")
        common.free_memory()
        rows = sorted(zip(t.column("text").to_pylist(), t.column("toxic").to_pylist()))
        toxic, ordinary = ([x for x, y in rows if y == k] for k in (1, 0))
        pair = dictionaries(toxic, ordinary) if toxic and ordinary else (b"", b"")
        return pa.table([pa.array([t.column("side")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in pair)], schema=schema)

    # Side 2 has all; sides 0 and 1 have the other half.
    sides = sample.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("side = 2 or side <> half")
    pairs = {r.side: (bytes(r.ordinary), bytes(r.toxic)) for r in sides.groupBy("side").applyInArrow(make, "side int, ordinary binary, toxic binary").collect()}
    if len(pairs) < 3 or not all(p[0] for p in pairs.values()):
        return Model()

    def count(batches):
        held: dict[int, Distance] = {}
        for b in common.freeing(batches, "toxicity"):
            for half in (0, 1):
                part = b.filter(pc.equal(b.column("half"), half))
                if part.num_rows:
                    if half not in held:
                        held[half] = Distance(*pairs[half])
                    counts = held[half].counts(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["toxic", "counts"])

    # At most TOXIC + ORDINARY rows of a few numbers.
    found = sample.repartition(F.xxhash64("text")).mapInArrow(count, "toxic int, counts array<long>").collect()
    y, counts = np.array([r.toxic for r in found]), np.array([r.counts for r in found]).reshape(-1, MOST)
    if not 0 < y.sum() < len(y):
        return Model()
    order = np.lexsort((*counts.T, y))
    y, counts = y[order], counts[order]
    thresholds = calibrated(counts[y == 0])
    return Model(*pairs[2], thresholds, fit_logistic(features(counts, thresholds), y).tolist())


_DISTANCES: dict[int, Distance] = {}
common.WORKER_CACHES["toxicity"] = _DISTANCES


def score_column(model: Model, spark: SparkSession, text: str = "text") -> Column:
    common.small_batches(spark)
    key = zlib.crc32(model.ordinary + model.toxic)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if key not in _DISTANCES:
            _DISTANCES.clear()
            _DISTANCES[key] = Distance(sent.value.ordinary, sent.value.toxic)
        common.keep_only("toxicity")
        parts = [sent.value.score(texts.iloc[at : at + 512].tolist(), _DISTANCES[key]) for at in range(0, len(texts), 512)]
        common.free_memory()
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.coalesce(F.col(text).cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    scored = common.pick(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that score below the threshold."""
    model = train(docs, labels)
    return docs.filter(score_column(model, docs.sparkSession) < THRESHOLD)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

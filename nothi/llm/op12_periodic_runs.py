"""Runs of repeated words, found for all lags with the bits of big integers.

A text's distinct words are numbered, and bit plane ``k`` is one big integer that holds bit ``k`` of every word's number. A plane XOR the same plane
shifted by ``q`` has a one wherever the words ``q`` apart differ in that bit; planes are ORed until nothing is left that could be long enough. A stretch of zeros of length ``z`` is a
stretch of ``z + q`` words with period ``q``. Zeros are isolated by AND with shifted copies of themselves, the shift doubling each time, so what is
left after some log(z) steps starts a stretch of at least ``z`` zeros.

A run is as long as its period lets it be, at least ``LEAST`` words and ``TIMES`` periods, and its period is the smallest that it has: a stretch that a smaller lag
has given already is not given again. (A stretch of four periods and a smaller period has, by the theorem of Fine and Wilf, one that divides
the lag, and the two stretches are the same.) Words that runs repeat are dropped: those of a run after its first period.

The work for a text grows with the square of its words, by a small factor: one lag takes some ten operations on integers of one bit a word. Nothing is cut off or
skipped; a text is held by one task.

Words are what stands between ASCII white space, compared byte by byte. Null and empty texts have no words and no runs. Null or repeated doc_ids and repeated rows are kept as they
are. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.llm import common

LEAST, TIMES = 6, 4
RUN = "array<struct<start:long,length:long,period:long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


class Planes:
    """The bit planes of some numbers, made as they are asked for."""

    def __init__(self, numbers: np.ndarray):
        self.numbers, self.made = numbers, []
        self.n = max(1, int(numbers.max(initial=0)).bit_length())

    def __getitem__(self, k: int) -> int:
        while len(self.made) <= k:
            bits = np.packbits(self.numbers >> len(self.made) & 1 != 0, bitorder="little")
            self.made.append(int.from_bytes(bits.tobytes(), "little"))
        return self.made[k]


def long_stretches(ones: int, least: int) -> int:
    """Bit i: a stretch of at least ``least`` ones begins at bit i or within what it leaves room for."""
    have = 1
    while have < least and ones:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def stretches(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last bit of each stretch of ones."""
    row = np.zeros(n + 2, np.int8)
    row[1 : n + 1] = np.unpackbits(np.frombuffer(bits.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n]
    step = np.diff(row)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def runs_of(numbers: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, found, seen = len(numbers), [], set()
    planes = Planes(numbers)
    for q in range(1, n // times + 1):
        zeros = max(1, least - q, (times - 1) * q)
        if zeros > n - q:
            break
        inside = (1 << (n - q)) - 1
        differ, starts = 0, 0
        for k in range(planes.n):
            plane = planes[k]
            differ |= plane ^ (plane >> q)
            starts = long_stretches(differ & inside ^ inside, zeros)
            if not starts:
                break
        if starts:
            for first, last in zip(*(a.tolist() for a in stretches(starts, n))):
                run = (first, last - first + zeros + q)
                if run not in seen:
                    seen.add(run)
                    found.append((*run, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs, collapsed (the text's kept words, joined by a space). No shuffle."""
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches):
        for b in batches:
            counts, runs, texts = [], [], []
            for text in b.column(1).to_pylist():
                words = text.split()
                found = runs_of(numbered(words), least, times)
                counts.append(len(words))
                runs.append(found)
                texts.append(b" ".join(kept_words(words, found)).decode())
            flat = [r for found in runs for r in found]
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.string())], schema=schema)

    rows = common.pick(docs, doc_id="long", text="string").select("doc_id", common.utf8("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by the checksum of its doc_id repeats a part of itself from some word on."""
    rows = common.pick(docs, doc_id="long", text="string").withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = F.coalesce((F.col("_h") % 10 == 0) & F.col("text").isNotNull(), F.lit(False))
    g = F.expr("_h div 10")
    words = F.filter(F.split(F.when(chosen, F.col("text")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.select("doc_id", "text", g.alias("_g"), words.alias("_w")).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.expr("array_join(transform(sequence(0, _n - 1), i -> _w[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, again).otherwise(F.col("text")).alias("text"))


def _sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(common.table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.withColumn("_m", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_m.start")).alias("start"),
        F.col("_m.length").alias("length"),
        (-F.col("_m.period")).alias("period"),
        F.expr("1000 * _m.length div -_m.period").alias("exponent_milli"),
        _sha256(lines).alias("runs_sha256"),
        _sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )
    return common.materialize(rows, "runs")

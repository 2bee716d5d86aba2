"""SimHash near-duplicates with pivot distance tables.

Fingerprints are taken once per document, from whole texts, and equal ones are one node from then on.
Every node carries its Hamming distances to reference fingerprints (pivots). By the triangle inequality two
fingerprints at most r bits apart have distances to any pivot that differ by r at most, so pairs
with a larger difference in any coordinate are discarded before the fingerprints are compared: the first two coordinates, in cells of 2 r + 1,
are part of the key of the join (one side is listed in its own cell, the other in each cell within r), the others are compared in the join. ``pivot_report`` counts what each step discards.

*Exact links* (``near_pairs``, radius 2): the 64 bits are four blocks, and two fingerprints within two bits agree
in at least two whole blocks, so six tables of 32-bit keys meet every pair. Keys that more than 64 nodes
share are joined another exact way: two fingerprints within two bits have a common neighbour within one bit of each,
so each node is listed under itself and its single flips in the bits outside the key; no such list is longer than 33.

*Links by similarity* (``drop_near_duplicates``, for 0.8 or more of shared five-word shingles): such pairs differ in about a seventh of the
bits, where no exact table of fingerprints pays, so the shingles themselves are compared; see ``shingle_join``.

Words are what stands between ASCII white space after A-Z is lowered; shingles of a text with fewer words are its whole sequence; a text
without words (null, empty or white space) has fingerprint zero and is linked like any other. Rows with a null doc_id get the component
of their fingerprint, null if no other row has it. Repeated rows fall in one node. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.llm import common
from nothi.llm.graph import connected_components

SEED, WORDS, RADIUS, PIVOTS, MOST = 42, 3, 2, 16, 64
#: Pivots whose cells are part of the key.
KEYED = 2
#: Bytes of a text that are cut into words at once.
LONG = 4 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length."""
    if len(text) <= LONG:
        yield text.lower().split()
        return
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + LONG)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, as unsigned 64-bit, big-endian, in parts."""
    from xxhash import xxh64_digest

    held, any_yet = [], False
    for part in words_of(text):
        held += part
        if len(held) < words:
            continue
        yield _hashes(held, words, seed, xxh64_digest)
        any_yet, held = True, held[len(held) - words + 1 :]
    if held and not any_yet:
        yield _hashes(held, len(held), seed, xxh64_digest)


def _hashes(split: list[bytes], k: int, seed: int, digest) -> np.ndarray:
    joined, ends = b" ".join(split), list(accumulate(len(w) + 1 for w in split))
    shingles = [joined[s : e - 1] for s, e in zip([0, *ends], ends[k - 1 :])]
    return np.frombuffer(b"".join(map(digest, shingles, repeat(seed))), ">u8")


def _mixed(hashes: np.ndarray, plane: int) -> np.ndarray:
    """A further hash of each hash (the finalizer of SplitMix64)."""
    if not plane:
        return hashes
    x = hashes.astype("<u8") + np.uint64(plane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).astype(">u8")


def fingerprint(text: bytes, words: int = WORDS, planes: int = 1) -> list[int]:
    """For each plane, the 64 bits that are set in over half of the shingles' hashes."""
    total, n = np.zeros((planes, 64), np.int64), 0
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            for p in range(planes):
                part = np.ascontiguousarray(_mixed(hashes[at : at + (1 << 15)], p))
                total[p] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return [int.from_bytes(np.packbits(2 * row > n).tobytes(), "big") if n else 0 for row in total]


def with_fingerprints(docs: DataFrame, words: int = WORDS, planes: int = 1) -> DataFrame:
    """doc_id and f0 (f1 ...): the fingerprint as signed 64-bit."""
    names = [f"f{p}" for p in range(planes)]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(batches):
        for b in batches:
            found = [fingerprint(t, words, planes) for t in b.column(1).to_pylist()]
            columns = [np.array([f[p] for f in found], np.uint64).view(np.int64) for p in range(planes)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], schema=schema)

    rows = common.pick(docs, doc_id="long", text="string").select("doc_id", common.utf8("text").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def pivots(planes: int = 1, n: int = PIVOTS) -> list[list[int]]:
    """Reference fingerprints, the same for every table."""
    return [[int(x) for x in row] for row in np.random.default_rng(7).integers(-(1 << 63), 1 << 63, (n, planes), dtype=np.int64)]


def _distance(planes: int, left, right) -> Column:
    return sum((F.bit_count(left(p).bitwiseXOR(right(p))) for p in range(1, planes)), F.bit_count(left(0).bitwiseXOR(right(0))))


def with_pivot_table(nodes: DataFrame, planes: int = 1) -> DataFrame:
    """Adds p0 ... : the distances of each node to the pivots."""
    return nodes.withColumns({f"p{k}": _distance(planes, lambda p: F.col(f"f{p}"), lambda p, ref=ref: F.lit(ref[p])).cast("short") for k, ref in enumerate(pivots(planes))})


def _apart(radius: int) -> Column:
    """The pivots allow a pair of a and b."""
    return F.greatest(*[F.abs(F.col(f"a.p{k}") - F.col(f"b.p{k}")) for k in range(PIVOTS)]) <= radius


def _by_cells(members: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Members in their own cell, and members in every cell that a fingerprint within the radius may be in."""
    width, base = 2 * radius + 1, [c for c in members.columns]
    own = members.select(*base, *[F.floor(F.col(f"p{k}") / width).cast("int").alias(f"c{k}") for k in range(KEYED)])
    near = members
    for k in range(KEYED):
        near = near.withColumn(f"c{k}", F.explode(F.array_distinct(F.array(*[F.floor((F.col(f"p{k}") + r) / width).cast("int") for r in (-radius, radius)]))))
    return own.alias("a"), near.alias("b")


def _met(members: DataFrame, on: list[str], radius: int) -> DataFrame:
    """Pairs of one list whose pivot distances allow it and whose fingerprints are near."""
    a, b = _by_cells(members, radius)
    cond = _apart(radius) & (_distance(1, lambda p: F.col(f"a.f{p}"), lambda p: F.col(f"b.f{p}")) <= radius) & (F.col("a.rep") < F.col("b.rep"))
    for c in [*on, *(f"c{k}" for k in range(KEYED))]:
        cond = (F.col(f"a.{c}") == F.col(f"b.{c}")) & cond
    return a.join(b, cond).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def _members(nodes: DataFrame) -> DataFrame:
    """The nodes with their pivot distances under each of six keys (t, key), where others share it, and the number that do (count)."""
    pivoted = with_pivot_table(nodes)
    blocks = [F.shiftrightunsigned("f0", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.shiftleft(blocks[j], 16).bitwiseOR(blocks[i]).alias("key")) for t, (i, j) in enumerate(combinations(range(4), 2))])
    listed = pivoted.withColumn("k", F.explode(keys)).select("k.t", "k.key", "rep", "f0", *[f"p{k}" for k in range(PIVOTS)])
    shared = common.materialize(listed.groupBy("t", "key").count().filter("count > 1"), "keys")
    return common.materialize(listed.join(shared, ["t", "key"]), "members")


def pivot_report(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """One row: pairs that share a key of at most ``most`` nodes, those that also share cells, those that all pivots allow, and those within the radius."""
    members = _members(nodes).filter(F.col("count") <= most)
    keyed = members.groupBy("t", "key").agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keyed"))
    a, b = _by_cells(members, RADIUS)
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("t", "key", *(f"c{k}" for k in range(KEYED)))] + [F.col("a.rep") < F.col("b.rep")])
    near = _distance(1, lambda p: F.col(f"a.f{p}"), lambda p: F.col(f"b.f{p}")) <= RADIUS
    return keyed.join(met.agg(F.count("*").alias("celled"), F.count_if(_apart(RADIUS)).alias("allowed"), F.count_if(near).alias("near")))


def near_pairs(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """All pairs (a, b) of nodes (rep, f0) at most RADIUS bits apart, each once."""
    members = _members(nodes)
    light = _met(members.filter(F.col("count") <= most), ["t", "key"], RADIUS)
    # The bits outside the two blocks of table t, and zero for the fingerprint itself.
    outside = [[0] + [1 << (16 * b + k) for b in range(4) if b not in pair for k in range(16)] for pair in combinations(range(4), 2)]
    flips = F.array(*[F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in row]) for row in outside])
    crowded = members.filter(F.col("count") > most).withColumn("flip", F.explode(F.element_at(flips, F.col("t").cast("int") + 1))).withColumn("mid", F.col("f0").bitwiseXOR(F.col("flip")))
    heavy = _met(crowded, ["t", "mid"], RADIUS)
    return light.union(heavy).distinct()


def components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, f0, component_id of every row."""
    rows = common.materialize(with_fingerprints(docs, words), "fingerprints")
    nodes = common.materialize(rows.groupBy("f0").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "nodes")
    labels = connected_components(near_pairs(nodes))
    of = common.materialize(nodes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("f0", F.coalesce("label", "rep").alias("component_id")), "components")
    return rows.join(of, "f0", "left")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` (all columns) but for near-duplicates: of each group one row stays, that with the smallest doc_id.

    Groups are what pairs with 0.8 or more of shared five-word shingles connect (``shingle_join``). Rows are told apart by doc_id and text, so
    different texts under one doc_id are judged each on its own. Of rows that repeat both one stays. A row with a null doc_id stays only if no row of its group has one.
    """
    from nothi.llm import shingle_join

    lost = shingle_join.lost_rows(docs)
    text = common.utf8("text")
    names = {"_nothi_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_nothi_h0": F.xxhash64(text), "_nothi_h1": F.xxhash64(F.lit(1), text)}
    keyed = docs.withColumns(names)
    again = common.materialize(keyed.select(*names).groupBy(*names).count().filter("count > 1").select(*names), "again")
    touched = shingle_join.maybe_in("_nothi_h0", lost.select("h0").union(again.select("_nothi_h0")))
    flagged = keyed.withColumn("_nothi_touched", touched)
    rest, looked = flagged.filter("not _nothi_touched"), flagged.filter("_nothi_touched")
    looked = looked.join(lost.select(*[F.col(c).alias(f"_nothi_{c}") for c in ("id", "h0", "h1")]), list(names), "left_anti")
    if not again.isEmpty():
        once = looked.join(again, list(names), "left_semi").dropDuplicates(list(names))
        looked = looked.join(again, list(names), "left_anti").unionByName(once)
    return rest.unionByName(looked).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")

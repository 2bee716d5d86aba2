"""Documents whose sets of five-word shingles are similar: Jaccard of 0.8 or more, all of them, whatever the size of the table.

Equal sets are one node from the start. Shingles are ordered from rare to common. Of two sets with a similarity of 0.8 or more the first
``n - ceil(0.8 n) + 1`` shingles of each have one in common, and the smaller has four fifths of the larger one's size at least. The order only decides how
much is compared, never what is found; commonness is counted over all documents, in a sketch of fixed size.

The SimHash of every set goes through the tables of ``op4_simhash.near_pairs``, whose pivots discard before fingerprints are compared: nodes with one fingerprint and nodes within two bits are
candidates. The nodes that have a shingle among their first ones make a list, which holds the similar pairs that lie farther apart. Each list is chained by size, and neighbours whose SimHash is near are candidates
as well. What of both is similar connects most of what belongs together, families of any size among them. Then the lists whose members are not all connected yet are gone through. That is done twice: first each node
takes its nearest partners only, which connects most of the rest, then all pairs count that are not connected by then.

A component of ``LARGE`` nodes or more stands for its members in these lists: what shares a list with one of them meets the component once, however many lists they share, in pairs of blocks. The other
members of a list meet each other, in pairs of blocks too, once for all lists that have the same ones.

In that step pairs are discarded before the sets are compared: by the parity of how many shingles fall on each bit of a bitmap. Every shingle that one of two sets has alone turns one bit, so bits in
which they differ are no more than those shingles, and of similar sets those are a ninth of both sizes at most. That bound loses nothing. Sets of up to ``CELLED`` shingles, where few bits decide, also
carry 16 bits of each: the shingles of one that have the bits of one of the other's are no fewer than those they share. Those that remain are compared shingle by shingle. No list is cut short.

Sets of over ``SKETCHED`` shingles carry a sketch: the smallest hash of each of ``BINS`` equal ranges. Two sets agree in a range that either reaches with a probability that is their similarity, so by the bound of
Chernoff sets with 0.8 or more agree in fewer ranges than ``FEWEST`` says with a chance under ``LOSS``. That is no proof, so it only spares the first pass comparisons; in the second, which has the last word, no pair is discarded by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nothi.llm import common
from nothi.llm.graph import connected_components
from nothi.llm.op4_simhash import near_pairs, shingle_hashes

WORDS = 5
#: Counters of the sketch (a power of two), and how many travel in one row.
CELLS, PART = 1 << 20, 1 << 14
#: Bytes of the bitmap of rows that a join needs.
MARKS = 1 << 23
#: Bits in which the SimHash of neighbours in a chain may differ; members of a block, about.
FAR, BLOCK = 26, 512
#: Nodes of a component that stands for its members in their lists.
LARGE = 64
#: Ranges of the sketch, the chance that the first pass misses a similar pair by it, and how many shingles a set without one has at most; partners that a node takes of one pair of blocks in the first pass.
BINS, LOSS, SKETCHED, PARTNERS = 128, 1e-9, 4096, 2
#: Bits of the smallest and of the widest bitmap of a set (powers of two), and how many for each shingle at least.
NARROWEST, WIDEST, SPACE = 256, 32768, 3
#: Shingles of a set that carries their bits; pairs that a task remembers, so as not to give them again for the next list.
CELLED, REMEMBERED = 64, 200_000
#: By what of two sets a pair is discarded.
PAYLOAD = ("bits", "sketch", "cells")


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    parts = [np.unique(h.astype("<u8")) for h in shingle_hashes(text, WORDS)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def digest(hashes: np.ndarray) -> np.ndarray:
    """128 bits of a set, as two signed 64-bit."""
    return np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard of 0.8 or more; two empty sets are equal."""
    both = len(x) + len(y)
    return 9 * (both - len(np.unique(np.concatenate([x, y])))) >= 4 * both


def sketch_of(hashes: np.ndarray) -> bytes:
    """For each range of hashes, a byte of the smallest one in it; zero where there is none. The hashes ascend."""
    out = np.zeros(BINS, np.uint8)
    bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    at = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[at]] = hashes[at] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def cells_of(hashes: np.ndarray) -> bytes:
    """16 bits of each hash of a set that is not too large."""
    return hashes.astype("<u2").tobytes() if len(hashes) <= CELLED else b""


def parity_of(hashes: np.ndarray) -> bytes:
    """A bitmap, as wide as the set asks for: the bits on which an odd number of hashes falls."""
    width = NARROWEST
    while width < min(WIDEST, SPACE * len(hashes)):
        width *= 2
    return np.packbits((np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis: bytes) as they would be with ``size`` bytes."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class Bitmaps:
    """Bitmaps of several widths, to be compared at the smaller width of two."""

    def __init__(self, rows: list[bytes]):
        self.rows, self.size = [np.frombuffer(r, np.uint8) for r in rows], np.array([len(r) for r in rows])
        self.tables: dict[int, np.ndarray] = {}

    def _table(self, size: int) -> np.ndarray:
        if size not in self.tables:
            out = np.zeros((len(self.rows), size), np.uint8)
            for k in np.flatnonzero(self.size >= size).tolist():
                out[k] = folded(self.rows[k], size)
            self.tables[size] = out.view(np.uint64)
        return self.tables[size]

    def differ(self, i: int, at: np.ndarray) -> np.ndarray:
        """In how many bits the i-th differs from those at ``at``."""
        out, sizes = np.zeros(len(at), np.int64), np.minimum(self.size[at], self.size[i])
        for size in np.unique(sizes).tolist():
            table, now = self._table(size), sizes == size
            out[now] = np.bitwise_count(table[at[now]] ^ table[i]).sum(axis=1)
        return out


def _fewest() -> np.ndarray:
    """By the number of ranges that either of two sets reaches: how many agree at least, but for the chance LOSS, if the similarity is 0.8."""
    out = np.zeros(BINS + 1, np.int64)
    for n in range(1, BINS + 1):
        k = np.arange(n + 1)
        a = k / n
        with np.errstate(divide="ignore", invalid="ignore"):
            away = np.where(k, a * np.log(a / 0.8), 0.0) + np.where(k < n, (1 - a) * np.log((1 - a) / 0.2), 0.0)
        # P(at most k agree) <= exp(-n * away) below the mean.
        out[n] = int(((a < 0.8) & (np.exp(-n * away) <= LOSS)).sum())
    return out


FEWEST = _fewest()


def promising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ranges in which sketches x (one) and y (rows) agree; -1 where they are too few for similar sets."""
    either = ((x | y) != 0).sum(axis=1)
    agree = ((x == y) & (x != 0)).sum(axis=1)
    return np.where(agree >= FEWEST[either], agree, -1)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def first_shingles(hashes: np.ndarray, common_ness: np.ndarray) -> np.ndarray:
    """The rarest shingles, of which similar sets share one; zero stands for the empty set."""
    n = len(hashes)
    if not n:
        return np.zeros(1, "<u8")
    return hashes[np.argsort(common_ness[_cell(hashes)], kind="stable")[: n - (4 * n + 4) // 5 + 1]]


def _texts(docs: DataFrame) -> DataFrame:
    """id (doc_id; the least long where it is null), text, and two hashes of the text, which tell rows of one doc_id apart."""
    rows = common.pick(docs, doc_id="long", text="string").select(row_id("doc_id").alias("id"), common.utf8("text").alias("text"))
    return rows.select("id", "text", F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1"))


def row_id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))


def _gathered(cells: DataFrame, size: int, dtype: str, put) -> Broadcast:
    """An array of fixed size that every task fills for itself by ``put(array, cells)``, added up in parts."""
    schema = pa.schema([("part", pa.int32()), ("cells", pa.binary())])

    def fill(batches):
        total, any_yet = np.zeros(size, dtype), False
        for b in common.freeing(batches):
            any_yet |= b.num_rows > 0
            put(total, b)
        for p in range(-(-size // PART) if any_yet else 0):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total[p * PART : (p + 1) * PART].tobytes()])], schema=schema)

    def add(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(c, dtype) for c in t.column("cells").to_pylist()]
        total = np.bitwise_or.reduce(parts) if dtype == "u1" else np.add.reduce(parts, dtype=dtype)
        return pa.table([t.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], schema=schema)

    total = np.zeros(size, dtype)
    for r in cells.mapInArrow(fill, "part int, cells binary").groupBy("part").applyInArrow(add, "part int, cells binary").collect():
        total[r.part * PART : (r.part + 1) * PART] = np.frombuffer(bytes(r.cells), dtype)
    return cells.sparkSession.sparkContext.broadcast(total)


def sketch(docs: DataFrame) -> Broadcast:
    """How often the shingles that fall in each cell occur in the documents."""

    def put(total, b):
        found = [_cell(shingle_set(t)) for t in b.column("text").to_pylist()]
        if found:
            at, n = np.unique(np.concatenate(found), return_counts=True)
            total[at] += n.astype("<u4")

    return _gathered(_texts(docs), CELLS, "<u4", put)


def _marked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = hashes.astype(np.uint64) & np.uint64(8 * MARKS - 1)
    return (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8)


def maybe_in(column: str, hashes: DataFrame) -> Column:
    """Whether a hash may be among those of ``hashes`` (one column), by a bitmap of fixed size: never false for one that is.

    What is false need not be shuffled to a join. With more hashes than bits it is always true, and only more is shuffled.
    """

    def put(total, b):
        at, bit = _marked(b.column(0).to_numpy())
        np.bitwise_or.at(total, at, bit)

    marks = _gathered(hashes, MARKS, "u1", put)

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        at, bit = _marked(h.to_numpy())
        return pd.Series((marks.value[at] & bit) != 0)

    return held(F.col(column))


def simhash(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of a set's hashes, as a signed number."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True) if len(hashes) else 0


def prints(docs: DataFrame, counts: Broadcast) -> DataFrame:
    """id, h0, h1, n (size of the set), d0 and d1 (its digest), f (its SimHash), keys (its first shingles), bits (its bitmap), sketch and cells of every row."""
    schema = pa.schema([*((c, pa.int64()) for c in ("id", "h0", "h1")), ("n", pa.int32()), *((c, pa.int64()) for c in ("d0", "d1", "f")), ("keys", pa.list_(pa.int64())), *((c, pa.binary()) for c in PAYLOAD)])

    def run(batches):
        for b in common.freeing(batches):
            if not b.num_rows:
                continue
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            d = np.stack([digest(s) for s in sets])
            keys = [first_shingles(s, counts.value).view("<i8") for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h0"), b.column("h1"), pa.array([len(s) for s in sets], pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([simhash(s) for s in sets], pa.int64()), lists, pa.array([parity_of(s) for s in sets], pa.binary()), pa.array([sketch_of(s) if len(s) > SKETCHED else b"" for s in sets], pa.binary()), pa.array([cells_of(s) for s in sets], pa.binary())], schema=schema)

    return _texts(docs).mapInArrow(run, "id long, h0 long, h1 long, n int, d0 long, d1 long, f long, keys array<long>, bits binary, sketch binary, cells binary")


def listed(nodes: DataFrame) -> DataFrame:
    """key, node, n, f and what stands before it in its list (pn, pm, pf), of all lists of two and more."""
    w = Window.partitionBy("key").orderBy("n", "node")
    before = [F.lag(c).over(w).alias(p) for c, p in (("node", "pnode"), ("n", "pn"), ("f", "pf"))]
    rows = nodes.select(F.explode("keys").alias("key"), "node", "n", "f").select("key", "node", "n", "f", *before, F.lead("node").over(w).alias("_next"))
    return rows.filter("pnode is not null or _next is not null").drop("_next")


def _near(f: str, g: str) -> Column:
    return F.bit_count(F.col(f).bitwiseXOR(F.col(g))) <= FAR


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar."""
    wanted = common.materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "id", "h0", "h1"), "node"), "wanted")
    texts = _texts(docs)
    texts = texts.filter(maybe_in("h0", wanted.select("h0"))).join(wanted, ["id", "h0", "h1"]).select("node", "text")
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])

    def hashed(batches):
        for b in common.freeing(batches):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], schema=schema)

    # Only the sets of repeated rows are shuffled to be taken once. The joins read a written table, so that Spark can split a node of many pairs.
    sets = common.materialize(texts.mapInArrow(hashed, "node long, hashes binary"), "sets")
    again = common.materialize(sets.groupBy("node").count().filter("count > 1").select("node"), "again")
    if not again.isEmpty():
        every = sets
        sets = common.materialize(every.join(again, "node", "left_anti").unionByName(every.join(again, "node", "left_semi").dropDuplicates(["node"])), "sets")
        common.release(every)
    found = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(batches):
        for b in common.freeing(batches):
            same = [alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=found).filter(pa.array(same, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    edges = common.materialize(both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long"), "similar")
    for t in (sets, wanted):
        common.release(t)
    return edges


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: nodes of one fingerprint with the first of them, and those with the first one within two bits, by the pivots' tables."""
    prints_ = common.materialize(nodes.groupBy("f").agg(F.min("node").alias("rep"), F.count("*").alias("m")), "fingerprints")
    equal = nodes.join(prints_.filter("m > 1").select("f", "rep"), "f").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = near_pairs(prints_.select("rep", F.col("f").alias("f0")))
    return equal.union(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))


def _parts(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _every(n: Column) -> Column:
    """One row for each block of n."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def _blocks(rows: DataFrame) -> DataFrame:
    """key, of, i, j, first, node, label of members of lists (key, node, label, of): key is the list, or of is the large component; i and j are blocks, and first tells that a row stands in i."""
    signs = [F.bit_xor(F.xxhash64("node")).alias("x0"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x1")]
    small = rows.filter("of is null").select("key", "node", "label")
    # Lists with the same members give the same pairs.
    lists = small.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), *signs).filter("lo <> hi")
    lists = common.materialize(lists.groupBy("m", "x0", "x1").agg(F.min("key").alias("key")).select("key", _parts("m").alias("parts")), "open")
    own = small.join(lists, "key").withColumn("own", F.pmod(F.xxhash64("label"), F.col("parts")).cast("int")).withColumn("other", _every(F.col("parts")))
    none, yes, no = F.lit(None).cast("long"), F.lit(True), F.lit(False)
    listed_ = own.select("key", none.alias("of"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"), "node", "label")
    large = rows.filter("of is not null").select("key", F.col("of").alias("large")).distinct()
    # Two large components meet under the smaller label.
    met = rows.join(large, (rows["key"] == large["key"]) & (rows["label"] != F.col("large")) & (F.col("of").isNull() | (F.col("of") > F.col("large"))))
    outer = common.materialize(met.select("large", "node", "label").distinct(), "outer")
    inner = common.materialize(rows.filter("of is not null").select(F.col("of").alias("large"), "node", "label").distinct(), "inner")
    n = inner.groupBy("large").agg(F.count("*").alias("p")).join(outer.groupBy("large").agg(F.count("*").alias("q")), "large")
    n = common.materialize(n.select("large", _parts("p").alias("p"), _parts("q").alias("q")), "parts")
    of = lambda i, j, first: (F.lit(None).cast("long").alias("key"), F.col("large").alias("of"), i.alias("i"), j.alias("j"), first.alias("first"), "node", "label")
    dealt = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    inside = inner.join(n, "large").select(*of(dealt("p"), _every(F.col("q")), yes))
    outside = outer.join(n, "large").select(*of(_every(F.col("p")), dealt("q"), no))
    return listed_.union(inside).union(outside)


def open_rows(lists: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """What is to be compared of the lists that ``labels`` (id, label) does not connect: the rows of ``_blocks``, with n and what pairs are discarded by. ``lists`` may tell neighbours that were not compared (apart)."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).filter(F.col("size") >= LARGE)
    known = labels.join(sizes, "label", "left").select(F.col("id").alias("node"), "label", F.when(F.col("size").isNotNull(), F.col("label")).alias("of"))
    apart = F.col("apart") if "apart" in lists.columns else F.lit(False)
    rows = common.materialize(lists.select("key", "node", apart.alias("apart")).join(known, "node", "left").select("key", "node", "apart", F.coalesce("label", "node").alias("label"), "of"), "rows")
    # Neighbours in a chain have been compared unless their SimHash is far; the other lists of two are done.
    open_lists = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("apart").alias("apart")).filter("lo <> hi and (m > 2 or apart)").select("key")
    blocks = common.materialize(_blocks(common.materialize(rows.join(open_lists, "key"), "rows")), "blocks")
    return blocks.join(nodes.select("node", "n", *PAYLOAD), "node").select("key", "of", "i", "j", "first", "node", "label", "n", *PAYLOAD)


def unconnected_pairs(rows: DataFrame, partners: int | None = None) -> DataFrame:
    """Candidate pairs (a, b) of ``open_rows``; with ``partners`` so many of each node in a pair of blocks at most, the nearest ones."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(group, held, seen):
        within = group[1] is None and group[2] == group[3]
        first = np.array([r[0] for r in held])
        node, label, n = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
        bits, sketches = Bitmaps([r[4] for r in held]), [np.frombuffer(r[5], np.uint8) for r in held]
        cells = [np.frombuffer(r[6], "<u2") for r in held]
        mark = np.zeros(1 << 16, bool)
        one, two = (np.arange(len(held)), np.arange(len(held))) if within else (np.flatnonzero(first), np.flatnonzero(~first))
        if len(one) > len(two):
            one, two = two, one
        for i in one.tolist():
            at = two[(label[two] != label[i]) & (5 * n[two] >= 4 * n[i]) & (5 * n[i] >= 4 * n[two])]
            if within:
                at = at[node[at] > node[i]]
            if len(at):
                apart = bits.differ(i, at)
                may = 9 * apart <= n[i] + n[at]
                at, apart = at[may], apart[may]
                if len(at) and len(cells[i]):
                    mark[cells[i]] = True
                    may = np.array([not len(cells[k]) or 9 * int(np.count_nonzero(mark[cells[k]])) >= 4 * (n[i] + n[k]) for k in at.tolist()])
                    mark[cells[i]] = False
                    at, apart = at[may], apart[may]
                if partners is not None and len(at) and len(sketches[i]):
                    may = np.array([not len(sketches[k]) or promising(sketches[i], sketches[k][None])[0] >= 0 for k in at.tolist()])
                    at, apart = at[may], apart[may]
                if partners is not None:
                    at = at[np.argsort(apart, kind="stable")[:partners]]
                pairs_ = {(min(a, int(node[i])), max(a, int(node[i]))) for a in node[at].tolist()}
                at = np.array(sorted(pairs_ - seen), np.int64).reshape(-1, 2)
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.update(pairs_)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], schema=schema)

    def met(batches):
        now, held, seen = None, [], set()
        for b in common.freeing(batches):
            for *group, first, node, label, n, bits, sketch_, cells in zip(*[c.to_pylist() for c in b.columns]):
                if group != now:
                    if held:
                        yield from pairs(now, held, seen)
                    now, held = group, []
                held.append((first, node, label, n, bits, sketch_, cells))
        if held:
            yield from pairs(now, held, seen)

    groups = ["key", "of", "i", "j"]
    found = rows.repartition(*groups).sortWithinPartitions(*groups, "node").mapInArrow(met, "a long, b long")
    return common.materialize(found.distinct(), "pairs")


def numbered(printed: DataFrame) -> DataFrame:
    """Adds to rows with an own number (row) the one of their node: that of the first row with the same set. Only rows of sets that may be repeated meet others."""
    first = F.min(F.struct("id", "h0", "h1", "row"))
    firsts = common.materialize(printed.groupBy("d0", "d1").agg(first.alias("first"), F.count("*").alias("m")).filter("m > 1").select("d0", "d1", F.col("first.row").alias("first")), "firsts")
    flagged = printed.withColumn("_again", maybe_in("d0", firsts.select("d0")))
    looked = flagged.filter("_again").join(firsts, ["d0", "d1"], "left").withColumn("node", F.coalesce("first", "row")).drop("first")
    return flagged.filter("not _again").withColumn("node", F.col("row")).unionByName(looked).drop("_again")


def similar_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed: id, h0, h1, node of every row; labels: id, label of the nodes that have a similar one)."""
    # The numbers of the rows hold from here on, as the table is written.
    printed = common.materialize(prints(docs, sketch(docs)).withColumn("row", F.monotonically_increasing_id()), "prints")
    rows = numbered(printed)
    placed = common.materialize(rows.select("id", "h0", "h1", "node"), "placed")
    own = rows.filter("row = node")
    nodes = common.materialize(own.select("node", "id", "h0", "h1", "n", "f", *PAYLOAD), "nodes")
    lists = common.materialize(listed(own), "lists")
    common.release(printed)
    fits = 5 * F.col("pn").cast("long") >= 4 * F.col("n").cast("long")
    chained = lists.filter(fits & _near("f", "pf")).select(F.least("node", "pnode").alias("a"), F.greatest("node", "pnode").alias("b"))
    edges = verified(common.materialize(print_pairs(nodes).union(chained).distinct(), "pairs"), nodes, docs)
    labels = connected_components(edges)
    lists = lists.withColumn("apart", F.coalesce(fits & ~_near("f", "pf"), F.lit(False)))
    for partners in (PARTNERS, None):
        more = unconnected_pairs(open_rows(lists, nodes, labels), partners)
        if not more.isEmpty():
            edges = edges.union(verified(more, nodes, docs))
            labels = connected_components(edges)
    common.release(lists)
    common.release(nodes)
    return placed, labels


def lost_rows(docs: DataFrame) -> DataFrame:
    """id, h0, h1 of the rows that are similar to a row that stays: of each component that with the smallest doc_id (null: the largest), then text hash."""
    placed, labels = similar_nodes(docs)
    rows = common.materialize(placed.join(labels.withColumnRenamed("id", "node"), "node", "left").select("id", "h0", "h1", F.coalesce("label", "node").alias("component")), "rows")
    order = F.struct((F.col("id") == -(1 << 63)).alias("null_last"), "id", "h0", "h1")
    first = rows.groupBy("component").agg(F.min(order).alias("kept"), F.count("*").alias("m")).filter("m > 1").select("component", F.col("kept.id").alias("kid"), F.col("kept.h0").alias("k0"), F.col("kept.h1").alias("k1"))
    return common.materialize(rows.join(first, "component").filter("id <> kid or h0 <> k0 or h1 <> k1").select("id", "h0", "h1").distinct(), "lost")

"""Cost-balanced packing into sequences of at most 2048 tokens.

A piece of n tokens costs ``linear * n + quadratic * n * n``: what grows with the tokens and
what attention inside the piece takes. Documents are packed in blocks of consecutive rows
of some four million tokens. Pieces, longest first, go to the sequence of lowest
cost that still has room for them; where none has, the piece is cut at the sequence with the
most room and the rest waits its turn. A block opens just as many sequences as it has
tokens for: full ones, and powers of two for the rest, so none is padded.

Of equally long pieces that of the first row goes first, of equally cheap sequences the first one is taken. Null texts are empty and take one token (the end id). Rows with null or repeated doc_ids are
packed like any other. An empty table gives no row. Extra columns are not read. Long
documents become several pieces; no id is dropped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nothi.llm import common, tokens

LENGTH, END, BLOCK_TOKENS = 2048, 1, 1 << 22
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenSequences:
    """Sequences by remaining room; finds that of least cost with room for n tokens in O(log length)."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.least = [(float("inf"), -1)] * (2 * self.size)

    def _renew(self, room: int) -> None:
        i, heap = room + self.size, self.heaps[room]
        least = self.least
        least[i] = heap[0] if heap else (float("inf"), -1)
        i >>= 1
        while i:
            a, b = least[2 * i], least[2 * i + 1]
            best = a if a <= b else b
            if least[i] == best:
                break
            least[i] = best
            i >>= 1

    def put(self, room: int, cost: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, sequence))
            self._renew(room)

    def take(self, n: int) -> tuple[int, float, int] | None:
        """(room, cost, sequence) of the cheapest with room for n; None if none has."""
        lo, hi, least = n + self.size, 2 * self.size, self.least
        node = 0
        best = (float("inf"), -1)
        while lo < hi:
            if lo & 1:
                if least[lo] < best:
                    node, best = lo, least[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                if least[hi] < best:
                    node, best = hi, least[hi]
            lo >>= 1
            hi >>= 1
        return self._pop(node) if node else None

    def _pop(self, node: int) -> tuple[int, float, int]:
        """Takes the cheapest below a node."""
        best = self.least[node]
        while node < self.size:
            node = 2 * node if self.least[2 * node] == best else 2 * node + 1
        room = node - self.size
        heapq.heappop(self.heaps[room])
        self._renew(room)
        return room, best[0], best[1]

    def widest(self) -> tuple[int, float, int]:
        i = 1
        while i < self.size:
            i = 2 * i + 1 if self.least[2 * i + 1][1] >= 0 else 2 * i
        return self._pop(i)


def room_for(total: int, length: int) -> list[int]:
    """Capacities that add up to total: full sequences, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block."""
    used, out = [], []
    rooms = OpenSequences(length)
    for room in room_for(sum(sizes), length):
        rooms.put(room, 0.0, len(used))
        used.append(0)
    waiting = []
    for doc, n in enumerate(sizes):
        for start in range(0, n, length):
            waiting.append((-min(length, n - start), doc, start))
    heapq.heapify(waiting)
    while waiting:
        n, doc, start = heapq.heappop(waiting)
        n = -n
        room, cost, sequence = rooms.take(n) or rooms.widest()
        part = min(n, room)
        out.append((doc, start, part, sequence, used[sequence]))
        used[sequence] += part
        rooms.put(room - part, cost + part * (linear + quadratic * part), sequence)
        if part < n:
            heapq.heappush(waiting, (part - n, doc, start + part))
    return out


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end: int = END, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC, block: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves. No shuffle: each task packs its own rows, a block at a time."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        from pyspark import TaskContext

        first, coder = TaskContext.get().partitionId() << 33, tokens.encoder(vocabulary)
        names, held, total = [], [], 0

        def flush():
            nonlocal first, names, held, total
            rows = []
            for doc, start, n, sequence, offset in pack([len(x) for x in held], length, linear, quadratic):
                ids = held[doc][start : start + n]
                rows.append((names[doc], start, n, common.crc32_u32(ids), len(held[doc]), first + sequence, offset) + ((ids.tolist(),) if with_ids else ()))
            first += max((r[5] - first for r in rows), default=-1) + 1
            names, held, total = [], [], 0
            for at in range(0, len(rows), 8192):
                columns = zip(*rows[at : at + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in common.freeing(batches, "tokens"):
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.ids(b.column(1).to_pylist(), end)):
                names.append(doc_id)
                held.append(np.asarray(ids))
                total += len(ids)
                if total >= block:
                    yield from flush()
        yield from flush()

    common.small_batches(docs.sparkSession)
    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA + ", ids array<long>" * with_ids)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))

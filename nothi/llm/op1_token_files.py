"""Token-ID output: Arrow stream files of equal-length sequences and masks.

A shard is a stream file whose record batches hold two fixed-size lists per row: ``ids``
(the narrowest unsigned integer that holds the vocabulary) and ``mask`` (false: padding).
Every batch but the last has ``rows`` rows, so row ``i`` lies in batch ``i // rows`` and is a
view into the mapped file. A second stream file lists the documents of the shard.
The ids run on from document to document; only a shard's last sequence is padded.

Null texts are empty (the end id alone). Very long texts are encoded in parts, to the ids of the whole. Null doc_ids come first,
repeated ones by a hash of their text. An empty table gives no file and no row. Extra columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nothi.llm import common, tokens

LENGTH, ROWS, END = 2048, 1024, 2
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(length: int, vocabulary: int) -> pa.Schema:
    width = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Appends documents to one shard; holds one record batch."""

    def __init__(self, uri: str, vocabulary: int, length: int = LENGTH, rows: int = ROWS):
        self.schema, self.length, self.room = file_schema(length, vocabulary), length, length * rows
        self.file, self.index_file = common.create(uri), common.create(uri + ".docs")
        self.out, self.index = pa.ipc.new_stream(self.file, self.schema), pa.ipc.new_stream(self.index_file, DOCS)
        self.held, self.n_held, self.total, self.rows, self.docs = [], 0, 0, [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for at in range(0, whole, self.room):
                self._batch(flat[at : at + self.room])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole
        if len(self.rows) >= 65536:
            self._index()

    def _batch(self, flat: np.ndarray) -> None:
        n = -(-len(flat) // self.length)
        ids, mask = np.zeros(n * self.length, self.schema.field("ids").type.value_type.to_pandas_dtype()), np.zeros(n * self.length, bool)
        ids[: len(flat)], mask[: len(flat)] = flat, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def _index(self) -> None:
        self.docs += len(self.rows)
        columns = list(zip(*self.rows)) or [(), (), ()]
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=DOCS))
        self.rows = []

    def close(self) -> None:
        if self.n_held:
            self._batch(np.concatenate(self.held))
        self._index()
        for x in (self.out, self.file, self.index, self.index_file):
            x.close()


class Shard:
    """Random access to a local shard: views into the mapped file, nothing is copied but the mask's bits."""

    def __init__(self, path: str):
        self.batches = list(pa.ipc.open_stream(pa.memory_map(path)))
        self.rows = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, at = self.batches[i // self.rows], i % self.rows
        ids, mask = batch.column(0), batch.column(1)
        length = ids.type.list_size
        return ids.values.slice(at * length, length).to_numpy(), mask.values.slice(at * length, length).to_numpy(zero_copy_only=False)


def read_documents(uri: str):
    """(doc_id, start in the shard, ids) of every document, from the shard's files, a batch at a time."""
    fs, path = common.open_fs(uri)
    with fs.open_input_file(path) as file, fs.open_input_file(path + ".docs") as index:
        stream, held = pa.ipc.open_stream(file), np.empty(0, "<u4")
        for docs in pa.ipc.open_stream(index):
            for doc_id, start, n in zip(*(docs.column(k).to_pylist() for k in range(3))):
                parts, have = [held], len(held)
                while have < n:
                    batch = stream.read_next_batch()
                    mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                    parts.append(batch.column(0).flatten().to_numpy()[mask].astype("<u4"))
                    have += len(parts[-1])
                flat = np.concatenate(parts) if len(parts) > 1 else held
                yield doc_id, start, flat[:n]
                held = flat[n:]


def write_token_files(docs: DataFrame, directory: str, vocabulary: str | None = None, end: int = END, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes shards in ascending doc_id order below ``directory``, which all executors share.

    Returns one row per shard: shard, path, n_docs, n_tokens, base (ids in the shards before it).
    The whole texts are dealt out by ranges of doc_id and text hash, once. A task that is run again writes
    a file of another name, and the manifest names the files of the tasks that counted.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        coder = tokens.encoder(vocabulary)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                uri = f"{directory}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.arrows"
                out = ShardWriter(uri, max(coder.size, end + 1), length, rows)
            for doc_id, ids in zip(b.column(0).to_pylist(), coder.ids(b.column(1).to_pylist(), end)):
                out.add(doc_id, ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, uri, out.docs, out.total), schema)], schema=schema)

    # Rows that share a doc_id, or all of it, are dealt out too.
    order = ["doc_id", "_text", "_tie"]
    keyed = common.pick(docs, doc_id="long", text="string").withColumns({"_text": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = common.materialize(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                rows = []
                for doc_id, start, ids in read_documents(path):
                    rows.append((doc_id, base + start, len(ids), common.crc32_u32(ids)))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    shards = max(1, manifest.count())
    return manifest.repartition(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, common.scratch_path(spark, "tokens")))

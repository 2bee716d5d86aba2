import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from nothi.llm import common, op1_token_files, op6_packing, tokens
from tests.llm.helpers import ROWS, docs, empty


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda s, end: np.array(t.encode(s or "", add_special_tokens=False).ids + [end], "<u4")


def test_segments_give_the_ids_of_the_whole(plain):
    random.seed(1)
    letters = list("ab1!'s -\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎ ​  　﻿é中") + ["<|endoftext|>"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 14))) for _ in range(5000)]
    coder = tokens.Encoder(tokens.default_vocabulary())
    for text, ids in zip(texts, coder.ids(texts, 2)):
        assert ids.tolist() == plain(text, 2).tolist()


def test_a_full_cache_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "CACHE", 3)
    monkeypatch.setattr(tokens.Encoder, "REFUSED", 5)
    coder, texts = tokens.Encoder(tokens.default_vocabulary()), [f"w{i} the {i * 7} and-{i}" + "z" * 60 for i in range(50)]
    for _ in range(2):
        assert [x.tolist() for x in coder.ids(texts, 1)] == [plain(t, 1).tolist() for t in texts]


def test_long_texts_in_parts(plain, monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "TOGETHER", 10)
    random.seed(2)
    texts = ["".join(random.choices("ab1!'s  \n\t-", k=random.randint(0, 90))) for _ in range(600)]
    coder = tokens.Encoder(tokens.default_vocabulary())
    assert [x.tolist() for x in coder.ids(texts, 2)] == [plain(t, 2).tolist() for t in texts]


def test_token_files_round_trip(spark, plain):
    manifest = op1_token_files.write_token_files(docs(spark), common.scratch_path(spark, "t"), length=16, rows=4)
    got = [tuple(r) for r in op1_token_files.read_token_files(manifest).collect()]
    want, start = [], 0
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain(text, 2)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_sequences_are_views(spark, plain):
    manifest = op1_token_files.write_token_files(docs(spark), common.scratch_path(spark, "t"), length=16, rows=4).collect()
    for row in manifest:
        shard = op1_token_files.Shard(row.path.removeprefix("file:"))
        flat, mask = zip(*(shard.sequence(i) for i in range(len(shard))))
        assert all(len(s) == 16 for s in flat) and flat[0].dtype == np.uint16 and not flat[0].flags.owndata
        kept = np.concatenate(flat)[np.concatenate(mask)]
        assert len(kept) == row.n_tokens
        assert np.concatenate([ids for _, _, ids in op1_token_files.read_documents(row.path)]).tolist() == kept.tolist()
        assert pa.ipc.open_stream(pa.memory_map(row.path.removeprefix("file:"))).schema == op1_token_files.file_schema(16, 50257)


def test_special_tokens_as_the_library_has_them(plain):
    coder = tokens.Encoder(tokens.default_vocabulary())
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>x", "<|endoftext|", "x" * 50 + " <|endoftext|>\n\nthe end"]
    assert [x.tolist() for x in coder.ids(texts, 2)] == [plain(t, 2).tolist() for t in texts]
    assert coder.ids(texts[:1], 2)[0].tolist() == [64, 50256, 65, 2]


def test_many_rows_of_one_id_are_dealt_out(spark, plain):
    rows = [(7 if i % 3 else None, f"text {i % 200}", None, None, None) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = op1_token_files.write_token_files(docs(spark, rows), common.scratch_path(spark, "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n_docs for r in manifest.collect()) < 1500
    out = op1_token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out[:-1])]).tolist() and [r.doc_id for r in out] == [None] * 1000 + [7] * 2000


def plain_pack(sizes, length):
    """Descending pieces to the cheapest sequence with room, cut at the widest where none has, by looking at all of them."""
    room = op6_packing.room_for(sum(sizes), length)
    used, cost = [0] * len(room), [0.0] * len(room)
    waiting = sorted((-min(length, n - s), d, s) for d, n in enumerate(sizes) for s in range(0, n, length))
    out = []
    while waiting:
        n, d, s = waiting.pop(0)
        fits = [q for q in range(len(room)) if room[q] >= -n]
        q = min(fits, key=lambda q: (cost[q], q)) if fits else min((q for q in range(len(room)) if room[q]), key=lambda q: (-room[q], cost[q], q))
        part = min(-n, room[q])
        out.append((d, s, part, q, used[q]))
        used[q], room[q], cost[q] = used[q] + part, room[q] - part, cost[q] + part * (op6_packing.LINEAR + op6_packing.QUADRATIC * part)
        if part < -n:
            waiting = sorted(waiting + [(part + n, d, s + part)])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_the_plain_rule_and_balances_cost(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(1, 60), r.randint(1, 400), 1]) for _ in range(r.randint(1, 400))]
    pieces = op6_packing.pack(sizes, 64)
    assert pieces == plain_pack(sizes, 64)
    if len(sizes) < 100:
        return
    # Cheaper to the dearest than filling sequences one after the other.
    def dearest(found):
        cost = {}
        for _, _, n, q, _ in found:
            cost[q] = cost.get(q, 0) + n * (1 + n / 64)
        full = [c for q, c in cost.items()]
        return max(full) - min(c for q, c in cost.items() if q < sum(sizes) // 64)

    line, at = [], 0
    for d, n in enumerate(sizes):
        s = 0
        while s < n:
            part = min(n - s, 64 - at % 64)
            line.append((d, s, part, at // 64, at % 64))
            at, s = at + part, s + part
    assert dearest(op6_packing.pack(sizes, 64, 1.0, 1 / 64)) <= dearest(line)


def test_empty(spark):
    assert op1_token_files.read_token_files(op1_token_files.write_token_files(empty(spark), common.scratch_path(spark, "t"))).count() == 0
    assert op6_packing.pack_documents(empty(spark)).count() == 0


def test_packing(spark, plain):
    rows = [tuple(r) for r in op6_packing.pack_documents(docs(spark), length=64, block=500, with_ids=True).collect()]
    by_seq, found = {}, []
    for doc_id, start, length, crc, total, seq, offset, ids in rows:
        assert len(ids) == length and zlib.crc32(np.array(ids, "<u4").tobytes()) == crc
        by_seq.setdefault(seq, []).append((offset, length))
        found.append((doc_id is None, doc_id or 0, total, start, ids))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    want = sorted((r[0] is None, r[0] or 0, plain(r[1], 1).tolist()) for r in ROWS)
    whole, held = [], {}
    for none, doc_id, total, start, ids in sorted(found):
        parts = held.setdefault((none, doc_id, total), {})
        parts.setdefault(start, []).append(ids)
    for (none, doc_id, total), parts in held.items():
        copies = len(parts[0])
        whole += [(none, doc_id, sum((parts[s][0] for s in sorted(parts)), []))] * copies if copies > 1 else [(none, doc_id, sum((parts[s][0] for s in sorted(parts)), []))]
    assert sorted((a, b, len(c)) for a, b, c in whole) == sorted((a, b, len(c)) for a, b, c in want)


@pytest.mark.parametrize("seed", range(5))
def test_pack_fills_and_balances(seed):
    r = random.Random(seed)
    sizes = [max(1, int(r.lognormvariate(4, 1.2))) for _ in range(400)]
    pieces = op6_packing.pack(sizes, 256)
    assert sum(p[2] for p in pieces) == sum(sizes)
    used, cost = {}, {}
    for _, _, n, s, _ in pieces:
        used[s] = used.get(s, 0) + n
        cost[s] = cost.get(s, 0) + n * (op6_packing.LINEAR + op6_packing.QUADRATIC * n)
    assert sorted(used.values()) == sorted(op6_packing.room_for(sum(sizes), 256))
    assert op6_packing.pack([], 256) == [] and op6_packing.pack([256], 256) == [(0, 0, 256, 0, 0)]


def test_the_cheapest_sequence_with_room():
    rooms = op6_packing.OpenSequences(8)
    for s, (room, cost) in enumerate([(8, 3.0), (4, 1.0), (8, 2.0), (2, 0.5)]):
        rooms.put(room, cost, s)
    assert [rooms.take(n)[2] for n in (3, 5, 1, 1)] == [1, 2, 3, 0] and rooms.take(1) is None

import zlib

import numpy as np

from nothi.llm import op10_hilbert_sharding as op10
from tests.llm.helpers import ROWS, docs, empty


def test_curve_visits_every_point_by_single_steps():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")
        levels = [g.ravel() for g in grid]
        index = op10.hilbert_index(levels, bits)
        assert sorted(index.tolist()) == list(range(1 << bits * n))
        path = np.stack(levels, axis=1)[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    rows = ROWS + [(100 + i, f"text {i % 7} " * (i % 13), "en", f"s{i % 5}", 0) for i in range(200)] + [(500, "same", "en", "s1", 0)] * 70
    out = op10.hilbert_shards(docs(spark, rows), shards=40).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    for s, held in by.items():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    order = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    want = sorted(((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == want


def test_boxes_hold_their_rows(spark):
    rows = op10.hilbert_shards(docs(spark), shards=4)
    boxes = {b.shard: b for b in op10.shard_boxes(rows).collect()}
    for r in rows.collect():
        b = boxes[r.shard]
        assert b.min_level_source <= r.level_source <= b.max_level_source and b.min_level_size <= r.level_size <= b.max_level_size
    assert sum(b.rows for b in boxes.values()) == len(ROWS)


def test_few_rows_and_none(spark):
    out = op10.hilbert_shards(docs(spark, ROWS[:3])).collect()
    assert len({r.shard for r in out}) == 3 and all(r.slot == 0 for r in out)
    assert op10.hilbert_shards(empty(spark)).count() == 0


def test_query(spark, sf_dir):
    out = op10.op10_hilbert_sharding(spark, sf_dir)
    assert dict(out.dtypes)["grown_shard"] == "int" and out.filter("law <> 'rows' or grown_shard is not null").count() == 0

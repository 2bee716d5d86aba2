import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from nothi.llm import common
from nothi.llm import op11_bpe_prefixes as op11
from tests.llm.helpers import ROWS, docs, empty


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(op11.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def bpe():
    return op11.PrefixBPE(op11.default_vocabulary())


LETTERS = list("ab1!'s -\n\t\r\x0b\x0c\x1c\x1f\x85\xa0᠎ ​　﻿é中ΑΣİ") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "é", "́", "ﬁ", "한", "ก", "²", "Ⅷ", "😀", "aaaa", "thethe", "A", "\x00"]


def test_ids_and_texts_are_the_librarys(bpe, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices(LETTERS, k=rng.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        (got,) = bpe.encode([text])
        assert got.tolist() == want, text
        assert bpe.decode(got.tolist()) == library.decode(want, skip_special_tokens=False)


def test_long_pieces(bpe, library):
    rng = random.Random(2)
    for letters in ("a", "ab", "thequickbrown", "中文字", "!?-"):
        text = "".join(rng.choices(letters, k=20_000))
        assert bpe.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_prefix_has_its_own_encoding(bpe):
    word = "unbelievablethethingsaaaaaaa"
    last = bpe.last_tokens(word)
    for end in range(1, len(word) + 1):
        ids, at = [], end - 1
        while at >= 0:
            ids.append(last[at])
            at -= bpe.size[last[at]]
        assert ids[::-1] == merged(bpe, word[:end])


def merged(bpe, letters):
    """Merge by merge: the lowest rank first, then the leftmost."""
    ids = [bpe.whole[c] for c in letters]
    while True:
        ranks = [(bpe.merges[a << 20 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 20 | b in bpe.merges]
        if not ranks:
            return ids
        rank, i = min(ranks)
        ids[i : i + 2] = [bpe.rank.index(rank)]


def test_small_caches_and_parts_change_nothing(library, monkeypatch):
    for name, value in (("WORDS", 3), ("PIECES", 2), ("PAIRS", 4), ("TOGETHER", 40)):
        monkeypatch.setattr(op11.PrefixBPE, name, value)
    bpe, rng = op11.PrefixBPE(op11.default_vocabulary()), random.Random(3)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 120))) for _ in range(300)] + [None, ""]
    assert [x.tolist() for x in bpe.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_files_are_refused(tmp_path):
    with open(op11.default_vocabulary(), encoding="utf-8") as f:
        file = json.load(f)
    for change in ({"dropout": 0.1}, {"byte_fallback": True}, {"merges": file["model"]["merges"][::-1]}):
        (tmp_path / "t.json").write_text(json.dumps(file | {"model": file["model"] | change}))
        with pytest.raises(ValueError):
            op11.PrefixBPE(str(tmp_path / "t.json"))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))


def test_query_on_whole_tables(spark, sf_dir, library):
    rows = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op11.op11_bpe_prefixes(spark, sf_dir).collect())
    assert got == sorted((r.doc_id, *expected(library, r.text)) for r in rows)


def test_odd_rows(spark, library, tmp_path):
    found = op11.encode_documents(docs(spark)).collect()
    want = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=key) == sorted(want, key=key)
    assert {r.decoded for r in found if not r.ids} == {""}
    assert op11.encode_documents(empty(spark)).collect() == []
    docs(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op11.op11_bpe_prefixes(spark, f"file://{tmp_path}").collect()
    assert sorted(((r[0], *r[1:]) for r in got), key=lambda p: (p[0] is not None, p[0] or 0, p[1:])) == sorted(((r[0], *expected(library, r[1])) for r in ROWS), key=lambda p: (p[0] is not None, p[0] or 0, p[1:]))

"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix that ends in token ``t`` is the encoding of what stands before ``t``, and ``t``. So one token for every prefix, its
last one, holds the encodings of all prefixes, and following them back from the end emits the ids of the whole. An automaton over the vocabulary gives the
tokens that end at each position. The last token of a prefix is the one among them that may stand after the last token of
what is left: a pair may stand side by side if no merge ever crosses the boundary while both grow. Only one token passes, so
the order of trying does not matter.

*Pairs.* A token grows from single letters by merges of rising rank. At the boundary stand the right edge of the left token and the left edge
of the right one, each from the rank that formed it until the rank that takes it in. Two edges that exist together and have a merge with a rank before either is taken in would
have merged. On equal ranks the leftmost merge goes first, so the left token's own one beats the crossing one, and that one beats the right token's. Tokens
that their own letters do not encode to (by the same test on their two halves) are left out of the automaton.

The end-of-word suffix makes the last letter of a piece another letter. Pieces come from the tokenizer file's normalizer and pre-tokenizer, word by word, as no
rule of theirs looks across white space. Added tokens are found in the text first, as they are written. Decoding puts the tokens together with a space, as the library does
for files without a decoder.

Files whose ranks do not rise, or with rules that this method does not know (dropout, a continuing prefix, byte fallback, a decoder, added tokens with
conditions), are refused with a ValueError.

Null and empty texts have no ids and decode to the empty text. Very long texts are read in parts; a word of any length takes time in proportion to it.
Null or repeated doc_ids and repeated rows are kept as they are. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.llm import common
from nothi.llm.tokens import WHITE_SPACE

_OTHER_SPACE = re.compile("[\x1c-\x1f]")
_WORD = re.compile(f"[^{WHITE_SPACE}]+")
_SPACE = re.compile(f"[{WHITE_SPACE}]")
_CODERS: dict[str, "PrefixBPE"] = {}
common.WORKER_CACHES["prefixes"] = _CODERS


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Kept:
    """Values of at most two generations of keys: what is asked for again stays, what is not goes with its generation."""

    #: Longer keys are not kept.
    CHARS = 64

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.young[key] = value
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= self.CHARS:
            self.young[key] = value
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}


class PrefixBPE:
    #: Words and pieces in a generation, pairs whose test is kept, letters that are split into words at once.
    WORDS, PIECES, PAIRS, TOGETHER = 100_000, 100_000, 1 << 19, 4_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in file["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if model["type"] != "BPE" or odd or file.get("decoder") or file.get("post_processor"):
            raise ValueError(f"no plain BPE file: {odd or path}")
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self._read_merges(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.ascii = self._ascii_rule(file["normalizer"], file["pre_tokenizer"])
        self.pairs: dict[int, bool] = {}
        self.words, self.pieces = Kept(self.WORDS), Kept(self.PIECES)

    @staticmethod
    def _ascii_rule(normalizer: dict, pre_tokenizer: dict) -> re.Pattern | None:
        """What splits lower-cased printable ASCII as the file's rules do, which are the library's to apply to anything else; None for other rules."""
        steps, parts = [n["type"] for n in (normalizer or {}).get("normalizers", [])], (pre_tokenizer or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            return None
        rule = parts[0]["pattern"].get("Regex", r"\p").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        return None if r"\p" in rule or not parts[0]["invert"] else re.compile(rule + "| ")

    def _read_merges(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        import ahocorasick

        n = max(vocab.values()) + 1
        #: The rank that forms a token (-1: a letter), its halves, and the ranks of pairs.
        self.rank, self.left, self.right, self.merges = [-1] * n, [-1] * n, [-1] * n, {}
        cut = len(self.suffix)
        for rank, (a, b) in enumerate(merges):
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[i << 20 | j] = rank
            if self.rank[made] >= 0:
                raise ValueError(f"token {a + b!r} is formed twice")
            self.rank[made], self.left[made], self.right[made] = rank, i, j
        if any(rank >= 0 and max(self.rank[i], self.rank[j]) >= rank for rank, i, j in zip(self.rank, self.left, self.right)):
            raise ValueError("a token is formed before its halves")
        #: Letters at the end of a word, as letters of their own.
        plain = {t[:-cut] if cut and t.endswith(self.suffix) and len(t) > cut else t for t in vocab}
        letters = sorted({c for t in plain for c in t})
        self.final = {c: chr(0xF0000 + k) for k, c in enumerate(letters)} if cut else {}
        self.automaton, self.whole, self.size = ahocorasick.Automaton(), {}, [0] * n
        sound = [r < 0 for r in self.rank]
        for token, i in sorted(vocab.items(), key=lambda p: self.rank[p[1]]):
            ended = cut and token.endswith(self.suffix) and len(token) > cut
            key = token[: -cut - 1] + self.final[token[-cut - 1]] if ended else token
            if self.rank[i] >= 0:
                a, b = self.left[i], self.right[i]
                sound[i] = sound[a] and sound[b] and self._side_by_side(a, b, made=True)
            if sound[i] and (self.rank[i] >= 0 or len(key) == 1):
                self.size[i] = len(key)
                self.whole[key] = i
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()

    def _side_by_side(self, a: int, b: int, made: bool = False) -> bool:
        """Whether no merge crosses the boundary of tokens a and b while they grow; ``made``: but for that of the two."""
        rank, merges = self.rank, self.merges
        a_taken, b_taken = math.inf, math.inf
        # From the whole tokens back in time, to the two letters.
        while True:
            met = merges.get(a << 20 | b)
            if met is not None and not made and met < a_taken and met <= b_taken:
                return False
            made = False
            if rank[a] > rank[b]:
                a_taken, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_taken, b = rank[b], self.left[b]
            else:
                return True

    def last_tokens(self, letters: str) -> list[int]:
        """For every prefix, from one letter on, the last token of its encoding."""
        last, pairs = [-1] * len(letters), self.pairs
        if len(pairs) > self.PAIRS:
            pairs.clear()
        for end, (token, n) in self.automaton.iter(letters):
            if last[end] >= 0:
                continue
            if n > end:
                last[end] = token
                continue
            before = last[end - n]
            pair = before << 20 | token
            fits = pairs.get(pair)
            if fits is None:
                fits = pairs[pair] = self._side_by_side(before, token)
            if fits:
                last[end] = token
        return last

    def piece(self, piece: str) -> bytes:
        """The ids of one piece of the pre-tokenizer."""
        letters = piece[:-1] + self.final[piece[-1]] if self.final else piece
        one = self.whole.get(letters)
        if one is not None:
            return array("I", (one,)).tobytes()
        last, size, out, at = self.last_tokens(letters), self.size, [], len(letters) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return array("I", out).tobytes()

    def _split(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Words and the pieces of each."""
        plain, rest = [], []
        for w in words:
            (plain if self.ascii and w.isascii() and w.isprintable() else rest).append(w)
        if plain:
            k, pieces = 0, []
            for piece in self.ascii.findall(" ".join(plain).lower() + " "):
                if piece != " ":
                    pieces.append(piece)
                    continue
                yield plain[k], pieces
                k, pieces = k + 1, []
        if rest:
            yield from zip(rest, self._library_pieces(rest))

    def _library_pieces(self, words: list[str]) -> list[list[str]]:
        whole = self.library.normalizer.normalize_str(" ".join(words))
        ends = [i for i, c in enumerate(whole) if c == " "] if len(words) > 1 else []
        if len(ends) != len(words) - 1:
            return [self._library_pieces([w])[0] for w in words]
        out, k, ends = [[] for _ in words], 0, [*ends, len(whole)]
        for piece, (begin, _) in self.library.pre_tokenizer.pre_tokenize_str(whole):
            while begin > ends[k]:
                k += 1
            out[k].append(piece)
        return out

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word."""
        known, new = {}, []
        for w in words:
            ids = self.words.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        one = self.pieces.get
        for at in range(0, len(new), 4096):
            for w, pieces in self._split(new[at : at + 4096]):
                ids = []
                for p in pieces:
                    got = one(p)
                    if got is None:
                        got = self.piece(p)
                        self.pieces.put(p, got)
                    ids.append(got)
                known[w] = ids = ids[0] if len(ids) == 1 else b"".join(ids)
                self.words.put(w, ids)
        return known

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts that end before white space."""
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + self.TOGETHER) if len(text) - at > self.TOGETHER else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text, as unsigned 32-bit."""
        out, group, size = [], [], 0
        for text in texts:
            special = bool(text and self.find_added and self.find_added.search(text))
            if special or text and len(text) > self.TOGETHER:
                out += self._together(group)
                group, size = [], 0
                split = self.find_added.split(text) if special else [text]
                runs = [np.array([self.added[x]], "<u4") if i % 2 else self._together([p])[0] for i, x in enumerate(split) for p in (self._parts(x) if i % 2 == 0 else [x])]
                out.append(np.concatenate(runs))
                continue
            group.append(text or "")
            size += len(group[-1])
            if size >= self.TOGETHER:
                out += self._together(group)
                group, size = [], 0
        return out + self._together(group)

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        # str.split also cuts at four control characters that are no white space.
        split = [_WORD.findall(t) if _OTHER_SPACE.search(t) else t.split() for t in texts]
        known = self._words(set().union(*split))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def coder(path: str) -> PrefixBPE:
    if path not in _CODERS:
        _CODERS[path] = PrefixBPE(path)
    return _CODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (the text that the ids decode to). No shuffle."""
    vocabulary = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        common.keep_only("prefixes")
        bpe = coder(vocabulary)
        for b in batches:
            found = bpe.encode(b.column(1).to_pylist())
            flat = np.concatenate(found).view("<i4") if found else np.zeros(0, "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array([bpe.decode(x.tolist()) for x in found], pa.string())], schema=schema)

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op11_bpe_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(common.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
    return common.materialize(rows, "encoded")

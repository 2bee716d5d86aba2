"""Whole-text encoding with the tokenizers library.

A byte-level BPE splits text before it merges, and no such piece has white space
after a character that isn't. So cutting just before each run of white space gives
segments whose ids, put together, are those of the whole text; equal segments are
encoded once per worker. The cache is emptied when it is full, which changes no id. Added tokens in a text (such as ``<|endoftext|>``) are found first, as the library
does by default, and what stands between them is encoded on its own.
"""

from __future__ import annotations

import os
import re

import numpy as np

from nothi.llm import common

#: The code points with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SEGMENT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_CUT = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")
_ENCODERS: dict[str, "Encoder"] = {}
common.WORKER_CACHES["tokens"] = _ENCODERS


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    #: Segments kept; beyond them new ones are encoded each time, and after as many of those as REFUSED all are forgotten.
    CACHE, REFUSED = 600_000, 1_800_000
    #: Longer segments are rare and not worth a place.
    CACHED_CHARS = 40
    #: Texts go through together up to so many characters.
    TOGETHER = 4_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(self.tokenizer.get_added_tokens_decoder().items(), key=lambda p: -len(p[1].content))
        #: Tokens with rules for what stands around them are left to the library, with the whole text.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added)
        self.added = {t.content: i for i, t in added}
        self.find = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if added else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: A byte-level token has one character for each byte.
        self.bytes_of = np.zeros(self.size, "int64")
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.refused = 0

    def _new(self, segments: list[str]) -> dict[str, bytes]:
        """Segments that begin with white space and don't end with it are encoded in one run and cut by their bytes; the rest one by one."""
        runs, alone = [], []
        for s in segments:
            (runs if s[0] in WHITE_SPACE and s[-1] not in WHITE_SPACE else alone).append(s)
        found = {s: np.array(e.ids, "<u4").tobytes() for s, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False))}
        for at in range(0, len(runs), 4096):
            part = runs[at : at + 4096]
            (run,) = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)
            ids = np.array(run.ids, "<u4")
            ends = np.cumsum([len(s.encode()) for s in part])
            cuts = (np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1) * 4
            data, begin = ids.tobytes(), 0
            for s, end in zip(part, cuts.tolist()):
                found[s] = data[begin:end]
                begin = end
        return found

    def _together(self, texts: list[str], last: bytes) -> list[np.ndarray]:
        known, split = self.known, [_SEGMENT.findall(x) for x in texts]
        new = list(set().union(*split).difference(known))
        room = self.CACHE - len(known)
        if new:
            known.update(self._new(new))
        out = [np.frombuffer(b"".join(map(known.__getitem__, segments)) + last, "<u4") for segments in split]
        refused = [s for s in new if len(s) > self.CACHED_CHARS] if len(new) <= room else new[room:]
        for s in refused:
            del known[s]
        self.refused += len(refused)
        if self.refused > self.REFUSED:
            known.clear()
            self.refused = 0
        return out

    def _long(self, text: str, last: bytes) -> np.ndarray:
        """The ids of a text that is too long to be cut into segments at once: part by part, each ending where a segment does."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + self.TOGETHER)
            end = cut.start() if cut else len(text)
            out += self._together([text[at:end]], b"")
            at = end
        return np.concatenate([*out, np.frombuffer(last, "<u4")])

    def _with_added(self, text: str, last: bytes) -> np.ndarray:
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids + np.frombuffer(last, "<u4").tolist(), "<u4")
        out = []
        for i, piece in enumerate(self.find.split(text)):
            if i % 2:
                out.append(np.array([self.added[piece]], "<u4"))
            elif piece:
                out.append(self._long(piece, b""))
        return np.concatenate([*out, np.frombuffer(last, "<u4")])

    def ids(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The ids of each whole text (null: empty) and the end id, as unsigned 32-bit."""
        last, out, group, size = np.array([end], "<u4").tobytes(), [], [], 0
        for text in texts:
            special = bool(text and self.find and self.find.search(text))
            if text and (special or len(text) > 2 * self.TOGETHER):
                out += self._together(group, last) if group else []
                out.append(self._with_added(text, last) if special else self._long(text, last))
                group, size = [], 0
                continue
            group.append(text or "")
            size += len(group[-1])
            if size >= self.TOGETHER:
                out += self._together(group, last)
                group, size = [], 0
        return out + (self._together(group, last) if group else [])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

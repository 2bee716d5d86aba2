"""Ordered replacements by long tables: each entry sees what the entries before it made.

Going through a table of hundreds of entries for every text is a search for each entry, and few occur. One automaton over all entries finds those that occur in one
pass; they wait in the order of the table. After an entry has changed the text only what stands around the changes is looked through again, for later entries that
came to be there. Where a text has many of the entries, looking around every change costs more than it saves, and the table is gone through as it stands. The result is that of going
through the whole table either way.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nothi.functions.bengali import text

#: Letters next to which a part is no whole word.
LETTERS = "ঀ-৿"
#: With one in so many entries in a text, the table is gone through.
DENSE = 8


class Replacer:
    """``pairs`` in order; with ``whole_words`` only parts with no letter of ``letters`` beside them."""

    def __init__(self, pairs: Iterable[tuple[str, str]], whole_words: bool = False, letters: str = LETTERS):
        import ahocorasick

        self.pairs, self.whole_words, self.letters = [(a, b) for a, b in pairs if a and a != b], whole_words, letters
        self.longest = max((len(a) for a, _ in self.pairs), default=0)
        self.rules: dict[int, re.Pattern] = {}
        places: dict[str, list[int]] = {}
        for k, (a, _) in enumerate(self.pairs):
            places.setdefault(a, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for a, ks in places.items():
            self.automaton.add_word(a, ks)
        if places:
            self.automaton.make_automaton()

    def _rule(self, k: int) -> re.Pattern:
        if k not in self.rules:
            bad = re.escape(self.pairs[k][0])
            self.rules[k] = re.compile(f"(?<![{self.letters}]){bad}(?![{self.letters}])" if self.whole_words else bad)
        return self.rules[k]

    def _replaced(self, s: str, k: int) -> tuple[str, list[int]]:
        """The text after one entry, and where its new parts begin."""
        good, out, at, ends, size = self.pairs[k][1], [], 0, [], 0
        for m in self._rule(k).finditer(s):
            out += (s[at : m.start()], good)
            size += m.start() - at + len(good)
            ends.append(size - len(good))
            at = m.end()
        return "".join([*out, s[at:]]) if ends else s, ends

    def _in_turn(self, s: str) -> tuple[str, int]:
        fired = 0
        for bad, good in self.pairs:
            if bad in s:
                s, fired = s.replace(bad, good), fired + 1
        return s, fired

    def __call__(self, s: str) -> tuple[str, int]:
        """(the text, how many entries changed it)."""
        fired, done = 0, -1
        if not self.pairs:
            return s, 0
        waiting = sorted({k for _, ks in self.automaton.iter(s) for k in ks})
        if not self.whole_words and len(waiting) * DENSE >= len(self.pairs):
            return self._in_turn(s)
        queued = set(waiting)
        while waiting:
            k = heapq.heappop(waiting)
            done = k
            s, starts = self._replaced(s, k)
            if not starts:
                continue
            fired += 1
            around, size = self.longest - 1, len(self.pairs[k][1])
            windows = [s] if len(starts) * (2 * around + size) >= len(s) else (s[max(0, at - around) : at + size + around] for at in starts)
            for window in windows:
                for _, ks in self.automaton.iter(window):
                    for j in ks:
                        if j > done and j not in queued:
                            queued.add(j)
                            heapq.heappush(waiting, j)
        return s, fired


def replaced(c: Column | str, pairs: Iterable[tuple[str, str]], whole_words: bool = False, letters: str = LETTERS) -> Column:
    """text and n (entries that changed it); a null is an empty text."""
    table = list(pairs)

    @F.pandas_udf("struct<text:string,n:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        replacer = Replacer(table, whole_words, letters)
        return pd.DataFrame([replacer(x) for x in s], columns=["text", "n"])

    return run(text(c))

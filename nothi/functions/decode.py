"""Legacy font encodings to Unicode.

Glyph tables and repair tables are parameters: ordered (from, to) pairs. The long folds (glyphs, ordered replacements,
normal form) run as Arrow-batched functions, as hundreds of nested native replacements exceed what the code generator
compiles; the short steps stay native in ``bengali``.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nothi.functions import bengali
from nothi.functions.bengali import MARK, text
from nothi.functions.ordered import Replacer

#: The widely published keyboard order of the Bijoy ANSI encoding, letters first, then signs.
BIJOY_LETTERS = {
    "A": "অ", "B": "ই", "C": "ঈ", "D": "উ", "E": "ঊ", "F": "ঋ", "G": "এ", "H": "ঐ", "I": "ও", "J": "ঔ", "K": "ক", "L": "খ", "M": "গ", "N": "ঘ", "O": "ঙ", "P": "চ", "Q": "ছ",
    "R": "জ", "S": "ঝ", "T": "ঞ", "U": "ট", "V": "ঠ", "W": "ড", "X": "ঢ", "Y": "ণ", "Z": "ত", "_": "থ", "`": "দ", "a": "ধ", "b": "ন", "c": "প", "d": "ফ", "e": "ব", "f": "ভ",
    "g": "ম", "h": "য", "i": "র", "j": "ল", "k": "শ", "l": "ষ", "m": "স", "n": "হ", "o": "ড়", "p": "ঢ়", "q": "য়", "r": "ৎ", "s": "ং", "t": "ঃ", "u": "ঁ",
}
BIJOY_SIGNS = {
    "v": "া", "w": "ি", "x": "ী", "y": "ু", "z": "ু", "~": "ূ", "…": "ৃ", "†": "ে", "‡": "ে", "ˆ": "ৈ", "‰": "ৈ", "Š": "ৗ", "&": "্",
}
BIJOY = BIJOY_LETTERS | BIJOY_SIGNS | {str(i): chr(0x9E6 + i) for i in range(10)}

#: Repairs of generic words after decoding, tried in this order; then runs of white space become one space.
REPAIRS = [("কিমশন", "কমিশন"), ("বগম", "বেগম"), ("হসন", "হোসেন"), ("নিবাচন", "নির্বাচন"), ("ভাটার", "ভোটার")]
#: Labels whose first sign was read before its consonant.
LABELS = [("িপতা", "পিতা"), ("িঠকানা", "ঠিকানা"), ("েপশা", "পেশা")]

_PRE = "\u09bf\u09c7\u09c8"
_SPACE = re.compile("[\\s\ufeff]{2,}")
_INITIAL = re.compile("(^|[\\s,;:\u0964\\-(])([\u09bf\u09c7\u09c8])([\u0995-\u09b9\u09dc-\u09df])", re.M)


def nfc(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x))

    return run(text(c))


def map_glyphs(c: Column | str, glyphs: dict[str, str]) -> Column:
    """Every glyph becomes its text; signs that are written before their consonant are marked."""
    table = str.maketrans({g: (MARK + t if t[:1] in _PRE and t else t) for g, t in glyphs.items()})

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.translate(table))

    return run(text(c))


def repair(c: Column | str, pairs: list[tuple[str, str]] | None = None, strict: bool = False) -> Column:
    """Ordered repairs, then single spaces, trimmed. ``strict`` replaces inside words too, which can spoil right words."""
    table = REPAIRS if pairs is None else pairs

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        replacer = Replacer(table, whole_words=not strict)
        return s.map(lambda x: _SPACE.sub(" ", replacer(x)[0]).strip("\ufeff \t\n\r\x0b\x0c\xa0"))

    return run(text(c))


def place_pre_signs(c: Column | str, labels: list[tuple[str, str]] | None = None, swaps: list[tuple[str, str]] = ()) -> Column:
    """Labels, then known swaps, then signs at the beginning of a word go behind their consonant."""
    table = [*(LABELS if labels is None else labels), *swaps]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        replacer = Replacer(table)
        return s.map(lambda x: _INITIAL.sub(r"\1\3\2", replacer(x)[0]))

    return run(text(c))


def convert(c: Column | str, glyphs: dict[str, str] = BIJOY, pairs: list[tuple[str, str]] | None = None, strict: bool = False) -> Column:
    """Legacy text to Unicode: mark, map glyphs, reorder, merge signs, normal form, repair, place signs, clean."""
    s = bengali.merge_signs(bengali.reorder_pre_signs(map_glyphs(bengali.mark_pre_signs(c), glyphs)))
    return bengali.strip(bengali.keep_bengali(place_pre_signs(repair(nfc(s), pairs, strict))))


def auto_convert(c: Column | str, hint: Column | None = None, tables: dict[str, dict[str, str]] | None = None, pairs: list[tuple[str, str]] | None = None, strict: bool = False) -> Column:
    """text and encoding. A hint beats detection; an unknown one means the first legacy table; empty texts are ``unknown``."""
    tables = tables or {"sutonny": BIJOY, "bijoy": BIJOY}
    s = text(c)
    encoding = F.when(s == "", "unknown").otherwise(F.coalesce(F.nullif(hint, F.lit("")), bengali.detect_encoding(s)) if hint is not None else bengali.detect_encoding(s))
    plain = F.trim(F.regexp_replace(nfc(bengali.merge_signs(place_pre_signs(repair(s, pairs, strict)))), "[\u00c0-\u024f]", ""))
    out = F.when(s == "", "").when(encoding == "unicode", plain)
    for name in [n for n in tables if n != "sutonny"]:
        out = out.when(encoding == name, convert(s, tables[name], pairs, strict))
    return F.struct(out.otherwise(convert(s, tables["sutonny"], pairs, strict)).alias("text"), encoding.alias("encoding"))

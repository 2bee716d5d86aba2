"""Bengali text as column expressions: search skeletons, digits, vowel signs, encodings.

Everything here stays in the JVM. Empty and null texts give an empty text unless said otherwise.
White space means what it does in Unicode, with U+FEFF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x{FEFF}]"
DIGITS_BN = "".join(chr(0x09E6 + i) for i in range(10))
DIGITS = "0123456789"
#: Consonant classes that sound alike, from left to right, and the letter that stands for each.
ALIKE = "\u09b7\u09b8\u09dc\u09dd\u09a3\u0988\u098a\u0999\u09ce\u09df"
STANDS_FOR = "\u09b6\u09b6\u09b0\u09b0\u09a8\u0987\u0989\u0982\u09a4\u09af"
#: A spelling error that is put right before skeletons are taken.
TYPO, TYPO_RIGHT = "\u09ac\u09bf\u09b2\u09cd\u09aa\u09ac", "\u09ac\u09bf\u09aa\u09cd\u09b2\u09ac"
#: Vowel signs, nukta, hasanta and the au mark, which a skeleton leaves out; nasal signs stay.
SIGNS = "[\u09bc\u09be-\u09cd\u09d7]"
CONSONANT = "[\u0995-\u09b9\u09dc-\u09df\u09ce\u09f0-\u09f1]"
PRE_SIGN = "[\u09bf\u09c7\u09c8]"
MARK = "\u0002"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def skeleton(c: Column | str) -> Column:
    """The consonant skeleton by which texts that sound alike are found. Only precomposed flapped letters become RA; decomposed ones lose their nukta."""
    fixed = F.translate(F.replace(text(c), F.lit(TYPO), F.lit(TYPO_RIGHT)), ALIKE, STANDS_FOR)
    return collapse(F.regexp_replace(fixed, SIGNS, ""))


def search_key(c: Column | str) -> Column:
    return F.lower(skeleton(c))


def to_bengali_digits(c: Column | str) -> Column:
    return F.translate(text(c), DIGITS, DIGITS_BN)


def parse_number(c: Column | str) -> Column:
    """The integer that a text begins with, in either digits, commas and spaces left out; 0 if it begins with none."""
    plain = F.translate(F.regexp_replace(text(c), r"(?U)[,\s\x{FEFF}]", ""), DIGITS_BN, DIGITS)
    return F.coalesce(F.regexp_extract(plain, "^[+-]?[0-9]{1,18}", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


#: Vowel signs that extraction splits or doubles and what they become, in this order.
SIGN_PAIRS = [
    ("\u09c7\u09be", "\u09cb"),
    ("\u09c7\u09d7", "\u09cc"),
    ("\u09be\u09c7", "\u09cb"),
    ("\u09c7\u09c7", "\u09c7"),
    ("\u09bf\u09bf", "\u09bf"),
    ("\u09cd\u09cd", "\u09cd"),
    ("\u09be\u09be", "\u09be"),
    ("\u09c1\u09c1", "\u09c1"),
    ("\u09c2\u09c2", "\u09c2"),
]


def merge_signs(c: Column | str) -> Column:
    """Split vowel signs are joined and doubled ones made single, one pass for each pair in turn."""
    out = text(c)
    for pair, one in SIGN_PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(one))
    return out


def mark_pre_signs(c: Column | str) -> Column:
    """Marks signs that stand before their consonant: those no consonant or hasanta goes before."""
    return F.regexp_replace(text(c), f"(?<![\u0995-\u09b9\u09dc-\u09df\u09ce\u09f0-\u09f1\u09cd])({PRE_SIGN})", MARK + "$1")


def reorder_pre_signs(c: Column | str) -> Column:
    """Moves marked signs behind the consonant cluster that follows; marks that have none go."""
    moved = F.regexp_replace(text(c), f"{MARK}({PRE_SIGN})({CONSONANT}(?:\u09cd{CONSONANT})*)", "$2$1")
    return F.replace(moved, F.lit(MARK), F.lit(""))


def keep_bengali(c: Column | str) -> Column:
    """Only Bengali, dandas, ASCII digits, spaces, tabs and ``/ . - , ( ) : ;`` stay."""
    return F.regexp_replace(F.replace(text(c), F.lit("\u00a0"), F.lit(" ")), "[^\u0980-\u09ff\u0964-\u09650-9 \\t/.\\-,():;]", "")


def _share(c: Column | str, chars: str) -> Column:
    s = text(c)
    n = F.length(s)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(s, F.lit(chars)) / F.greatest(n, F.lit(1)))


def legacy_share(c: Column | str) -> Column:
    return _share(c, "[\u00c0-\u024f]")


def control_share(c: Column | str) -> Column:
    return _share(c, "[\u0080-\u00bf]")


def detect_encoding(c: Column | str) -> Column:
    """``unicode``, ``sutonny`` or ``bijoy``. Texts under four characters and texts without characters from U+0080 to U+024F are unicode, plain ASCII included."""
    s = text(c)
    bengali, latin = s.rlike("[\u0980-\u09ff]"), s.rlike("[\u00c0-\u024f]")
    keys = F.regexp_count(s, F.lit("[abcgjknprst]"))
    return (
        F.when(F.length(s) < 4, "unicode")
        .when((legacy_share(s) == 0) & (control_share(s) == 0), "unicode")
        .when(control_share(s) > 0.05, "sutonny")
        .when(bengali & latin, "sutonny")
        .when(~bengali & (keys > F.length(s) * F.lit(0.3)), "bijoy")
        .when(latin, "sutonny")
        .otherwise("unicode")
    )


def clean_name_prefix(c: Column | str) -> Column:
    """Leading invisible characters, the label for a name, and punctuation go."""
    s = F.regexp_replace(text(c), "^(?U)[\\s\u200b-\u200d\ufeff]+", "")
    s = F.regexp_replace(s, "^(?U)(\u09a8\u09be\u09ae|\u09a8\u09be\u0983|\u09a8\u09be\u09b8|\u09a8\u09be\u09ae\u09c7\u09b0|\u09a8\u09be\u09ae\u0983)[\\s\ufeff:\u0964\\-._]*", "")
    return strip(F.regexp_replace(s, "^(?U)[\\s\ufeff:\u0964\\-._]+", ""))


def date_token(c: Column | str) -> Column:
    """The first d/m/yyyy in either digits, as text."""
    return F.regexp_extract(text(c), f"([{DIGITS_BN}0-9]{{1,2}}/[{DIGITS_BN}0-9]{{1,2}}/[{DIGITS_BN}0-9]{{4}})", 1)


def ward_from_text(c: Column | str) -> Column:
    """The number before the word for a ward."""
    ya = "(?:\u09df|\u09af\u09bc)"
    return F.regexp_extract(text(c), f"(?U)([0-9{DIGITS_BN}]+)\\s*(?:\u09a8\u0982)?\\s*\u0993{ya}\u09be\u09b0\u09cd\u09a1", 1)


def first_filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty; else an empty text."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))

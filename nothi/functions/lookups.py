"""Lookup tables: a small stock of generic words and the public list of districts, and ways to bring one's own.

Every table is a list of plain rows. The operators take them as parameters, so a user's tables replace or extend
these; ``from_table`` reads one from a DataFrame of proven size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Generic words with their right form.
WORDS = [(w, w) for w in "নির্বাচন কমিশন ভোটার তালিকা জেলা উপজেলা পরিষদ নম্বর গ্রাম পিতা মাতা পেশা ঠিকানা তারিখ জন্ম কৃষক শিক্ষক শ্রমিক ব্যবসা গৃহিণী বেগম শেখ মহিলা পুরুষ".split()]

#: Common misreadings of generic words, in the order in which they are tried.
MISREAD = [("নিবাচন", "নির্বাচন"), ("কিমশন", "কমিশন"), ("ভাটার", "ভোটার"), ("তািলকা", "তালিকা"), ("পিরষদ", "পরিষদ"), ("নণ্ডর", "নম্বর"), ("িপতা", "পিতা"), ("কৃযক", "কৃষক"), ("শখ", "শেখ"), ("বগম", "বেগম"), ("মিহলা", "মহিলা"), ("গৃহিনী", "গৃহিণী")]

#: Widely used given names and surnames with other spellings: (kind, name, spellings).
NAMES = [
    ("male", "মোহাম্মদ", ["মুহাম্মদ", "মোহাম্মাদ"]),
    ("male", "করিম", ["করীম"]),
    ("male", "রহিম", ["রহীম"]),
    ("male", "কামাল", ["কামল"]),
    ("male", "আহমদ", ["আহম্মদ"]),
    ("female", "ফাতেমা", ["ফাতিমা"]),
    ("female", "আমেনা", ["আমিনা"]),
    ("female", "সালমা", []),
    ("surname", "হোসেন", ["হোসাইন", "হুসেন"]),
    ("surname", "আহমেদ", ["আহমদ"]),
    ("surname", "খাতুন", ["খাতুণ"]),
    ("surname", "আলী", ["আলি"]),
    ("surname", "বেগম", ["বেগমে"]),
]

#: The eight divisions of Bangladesh and their 64 districts, in the order of the divisions.
DIVISIONS = {
    "বরিশাল": "বরিশাল ভোলা ঝালকাঠি পটুয়াখালী পিরোজপুর বরগুনা",
    "চট্টগ্রাম": "চট্টগ্রাম কক্সবাজার কুমিল্লা ফেনী লক্ষ্মীপুর নোয়াখালী চাঁদপুর ব্রাহ্মণবাড়িয়া খাগড়াছড়ি রাঙ্গামাটি বান্দরবান",
    "ঢাকা": "ঢাকা গাজীপুর নারায়ণগঞ্জ নরসিংদী মানিকগঞ্জ মুন্সিগঞ্জ টাঙ্গাইল কিশোরগঞ্জ ফরিদপুর গোপালগঞ্জ মাদারীপুর রাজবাড়ী শরীয়তপুর",
    "খুলনা": "খুলনা বাগেরহাট সাতক্ষীরা যশোর ঝিনাইদহ মাগুরা নড়াইল কুষ্টিয়া চুয়াডাঙ্গা মেহেরপুর",
    "ময়মনসিংহ": "ময়মনসিংহ জামালপুর নেত্রকোনা শেরপুর",
    "রাজশাহী": "রাজশাহী বগুড়া জয়পুরহাট নওগাঁ নাটোর চাঁপাইনবাবগঞ্জ পাবনা সিরাজগঞ্জ",
    "রংপুর": "রংপুর দিনাজপুর গাইবান্ধা কুড়িগ্রাম লালমনিরহাট নীলফামারী পঞ্চগড় ঠাকুরগাঁও",
    "সিলেট": "সিলেট হবিগঞ্জ মৌলভীবাজার সুনামগঞ্জ",
}
#: Other spellings of districts.
DISTRICT_SPELLINGS = {"চট্টগ্রাম": ["চট্টগ্রম"], "লক্ষ্মীপুর": ["লক্ষীপুর"], "বান্দরবান": ["বান্দরবন"], "চাঁদপুর": ["চান্দপুর"], "ঝালকাঠি": ["ঝালোকাঠি"]}
#: Upazilas by district, for the districts that have data; others pass.
UPAZILAS = {"খুলনা": "দৌলতপুর তেরখাদা পাইকগাছা কয়রা ফুলতলা".split(), "সিলেট": "গোলাপগঞ্জ কানাইঘাট জকিগঞ্জ বিশ্বনাথ".split(), "যশোর": "অভয়নগর চৌগাছা কেশবপুর শার্শা".split()}

DISTRICTS = [(d, division) for division, names in DIVISIONS.items() for d in names.split()]


def variants(rows: list[tuple[str, list[str]]]) -> dict[str, str]:
    """spelling -> name; a name is its own spelling, later rows win."""
    out: dict[str, str] = {}
    for name, spellings in rows:
        out[name] = name
        out |= {s: name for s in spellings if s != name}
    return out


def name_spellings(names: list = NAMES) -> dict[str, str]:
    """All spellings; surnames win over first names."""
    given = variants([(n, s) for kind, n, s in names if kind != "surname"])
    return given | variants([(n, s) for kind, n, s in names if kind == "surname"])


def canonical_names(names: list = NAMES) -> list[str]:
    """Each name once: first names, then surnames."""
    return list(dict.fromkeys([n for kind, n, _ in names if kind != "surname"] + [n for kind, n, _ in names if kind == "surname"]))


def district_spellings(spellings: dict[str, list[str]] = DISTRICT_SPELLINGS) -> dict[str, str]:
    return variants([(d, spellings.get(d, [])) for d, _ in DISTRICTS])


def spellings_table(names: DataFrame) -> DataFrame:
    """spelling and name, from a table (kind, place, name, spellings): every name and spelling once; surnames over first names, then later places over earlier ones."""
    every = names.select("place", (F.col("kind") == "surname").alias("last"), "name", F.explode(F.array_union(F.array("name"), F.coalesce("spellings", F.array().cast("array<string>")))).alias("spelling"))
    return every.groupBy("spelling").agg(F.max_by("name", F.struct("last", "place")).alias("name"))


def from_table(df: DataFrame, most: int = 10_000) -> list[tuple]:
    """The rows of a lookup table; more than ``most`` is an error, as lookups are sent to every executor."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lookup table may have {most} rows at most")
    return [tuple(r) for r in rows]


def extended(words: list[tuple[str, str]], more: dict[str, str]) -> list[tuple[str, str]]:
    """The word list with a user's words; an existing word keeps its place and takes the new form."""
    return list((dict(words) | more).items())

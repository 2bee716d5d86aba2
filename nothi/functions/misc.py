"""Small conversions around records, logs and files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from nothi.functions.bengali import strip, text


def client_ip(forwarded: Column | str, remote: Column | str | None = None) -> Column:
    """The first address of a forwarding header, else the remote one, else the local one."""
    first = F.nullif(text(forwarded), F.lit(""))
    other = F.nullif(text(remote), F.lit("")) if remote is not None else F.lit(None).cast("string")
    return F.trim(F.split(F.coalesce(first, other, F.lit("127.0.0.1")), ",")[0])


#: Labels of the search fields, in order, and what a search without fields is called.
SEARCH_LABELS = [
    ("name", "নাম"),
    ("father", "পিতা"),
    ("mother", "মাতা"),
    ("village", "গ্রাম/মহল্লা"),
    ("area", "এলাকা"),
    ("upazila", "উপজেলা"),
    ("district", "জেলা"),
    ("number", "ভোটার নম্বর"),
    ("nid", "NID"),
]
SEARCH_ANY = "সাধারণ অনুসন্ধান"


def search_summary(fields: dict[str, Column | str]) -> Column:
    """What was asked for, ``label: value`` for every field that is given."""
    parts = [F.when(text(fields[k]) != "", F.concat(F.lit(label + ": "), text(fields[k]))) for k, label in SEARCH_LABELS if k in fields]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit(SEARCH_ANY))


def search_method(village: Column | str) -> Column:
    return F.when(text(village) != "", "VILLAGE_SEARCH").otherwise("NAME_SEARCH")


def size_mb(n_bytes: Column) -> Column:
    """Whole bytes (under 10 ** 17) as megabytes with two places: of the exact quotient, ties to the even digit."""
    return F.concat(F.bround(n_bytes.cast("decimal(17,0)") * F.lit(Decimal(1) / 1048576), 2).cast("string"), F.lit(" MB"))


def ellipsis(c: Column | str, most: int = 35) -> Column:
    s = text(c)
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit("..."))).otherwise(s)


def file_safe(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?U)[\s\x{FEFF}]+", "_")


def latin1_to_utf8(c: Column | str) -> Column:
    """A UTF-8 name that was read as Latin-1, put right."""
    return F.decode(F.encode(text(c), "ISO-8859-1"), "UTF-8")


def unfenced_json(c: Column | str, schema: str) -> Column:
    """JSON that may stand between code fences; null where it is none."""
    return F.from_json(strip(F.regexp_replace(text(c), "```(?:json)?", "")), schema)


def row_diff(fields: list[str], old: str = "old", new: str = "new") -> Column:
    """Fields whose new value is filled and differs, as structs of field, was and now."""
    parts = []
    for f in fields:
        a, b = text(F.col(f"{old}.{f}")), text(F.col(f"{new}.{f}"))
        parts.append(F.when((b != "") & (a != b), F.struct(F.lit(f).alias("field"), a.alias("was"), b.alias("now"))))
    return F.array_compact(F.array(*parts))


def address_parts(address: Column | str, village: Column | str, upazila: Column | str, district: Column | str) -> Column:
    """village, upazila and district; where one is empty it is taken from an address of three parts or more, split at commas or bars."""
    parts = F.filter(F.transform(F.split(text(address), "[,|]"), strip), lambda x: x != "")
    part = lambda i: F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(i)))
    pick = lambda c, i: F.coalesce(F.nullif(text(c), F.lit("")), part(i), F.lit(""))
    return F.struct(pick(village, 1).alias("village"), pick(upazila, -2).alias("upazila"), pick(district, -1).alias("district"))


def serial_on_page(serial: Column, per_page: int = 15) -> Column:
    return ((serial - 1) % per_page + 1).cast("int")

"""Records from page lines: cover fields and register entries, by expressions and windows only.

*Cover.* A lexicon says which words label a field, what kind of value follows, and whether the first or the last value counts. One grammar makes
the patterns: a label, separators, a value of the kind. Where a label has no value on its line, the next lines may have it, by one rule for all fields.

*Entries.* Lines that begin with a serial number and a dot are markers. A marker with white space or a danda behind the dot always ends the entry before;
one without begins an entry only where no other is within reach. Lines get running numbers of lines and of strong markers, counted page by page and added up over
the pages, so one long document, or all rows without one, is dealt out by its pages. Between strong markers the weak ones are taken greedily, which is a fold over those
alone. Each line of an entry is of one kind by the first label that it holds, and the fields of an entry are aggregates of its lines.

Other registers bring other lexicons (``Field``, ``Label``) and no other code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nothi.functions.bengali import DIGITS, DIGITS_BN, clean_name_prefix, date_token, first_filled, parse_number, strip, text
from nothi.operators.correct import contained_entry

DIGIT = f"[{DIGITS_BN}{DIGITS}]"
DANDA = "।"
#: The letter of "union" and "ward" that is written in two ways.
_YA = "(?:য়|য়)"
_UNION, _WARD = f"ইউনি{_YA}ন", f"(?:ও{_YA}ার্ড|ও{_YA}াডে)"
MALE, FEMALE = "পুরুষ", "মহিলা"

#: What a value may be: any text up to the next cell of the line, or characters of some kind.
TEXT, NUMBER, AMOUNT, DATE = ".", DIGIT, f"[{DIGITS_BN}{DIGITS},]", f"[{DIGITS_BN}{DIGITS}/]"
SEPARATOR = f"[:\\s{DANDA}]"


@dataclass(frozen=True)
class Field:
    """A field of the cover. ``label``: the words before its value; ``named``: what a line needs to be looked at (the label, if not given)."""

    name: str
    label: str
    kind: str = TEXT
    #: Other words may stand between the label and the separator; there may be no separator.
    loose: bool = False
    bare: bool = False
    named: str = ""
    never: str = ""
    #: The last value counts, and not the first.
    last: bool = False
    #: Lines after the label's that may hold the value.
    reach: int = 0
    #: Words that such a line can't hold.
    not_next: str = ""
    gender: str = ""

    @property
    def pattern(self) -> str:
        return f"(?U)(?:{self.label}){'[^:]*' if self.loose else ''}{SEPARATOR}{'*' if self.bare else '+'}({self.kind}+)"


#: The labels of a register's cover.
COVER = [
    Field("district", "জেলা", reach=1),
    Field("upazila", "(?:উপজেলা|থানা)[/\\s]*(?:থানা)?", named="উপজেলা|থানা", reach=1, not_next=_UNION),
    Field("union_name", f"{_UNION}|{_WARD}", loose=True, named=f"{_UNION}|ও{_YA}ার্ড/|ও{_YA}াডে", reach=2, not_next=f"{_WARD}|ক্যাণ্ট|বোর্ড|বোডে"),
    Field("ward_no", f"{_WARD}\\s*(?:নম্বর|নং)", NUMBER, loose=True, named=f"{_WARD} (?:নম্বর|নং)", last=True, reach=1),
    Field("area_no", "ভোটার এলাকা(?:র)?\\s*(?:নম্বর|কোড)", NUMBER, named="ভোটার এলাকার? ?(?:নম্বর|কোড)", last=True, reach=1),
    Field("area", "ভোটার এলাকা(?:র নাম)?", bare=True, named="ভোটার এলাকা", never="নম্বর|কোড", reach=1),
    Field("total", "(?:সর্ব|সব)মোট ভোটার", AMOUNT, loose=True, last=True, reach=1),
    Field("total_male", "মোট পুরুষ", AMOUNT, loose=True, last=True, reach=1, gender=MALE),
    Field("total_female", "মোট মহিলা", AMOUNT, loose=True, last=True, gender=FEMALE),
    Field("published", "প্রকাশ(?:ের)? তারিখ", DATE, last=True),
    Field("post_code", "পো(?:স্ট|ষ্ট)কোড", NUMBER, last=True),
]
#: The post office names the area where nothing else does.
POST_OFFICE = Field("area", "ডাক(?:ঘর)?", bare=True, named="ডাকঘর|ডাকঃ")
LIST = "তালিকা"


def _value(f: Field, line: Column) -> Column:
    """The field's value on its label's line; null for none."""
    found = F.regexp_extract(line, f.pattern, 1)
    if f.kind == AMOUNT:
        return F.nullif(parse_number(found), F.lit(0).cast("bigint"))
    if f.kind == TEXT:
        found = strip(F.regexp_extract(strip(F.translate(found, "।॥", "") if f.name == "district" else found), "(?U)^(.*?)(?:\\t|\\s{2,}|$)", 1))
    return F.nullif(found, F.lit(""))


def _follows(f: Field, line: Column) -> Column:
    """The value that a later line is; null if it can't be one."""
    if f.kind == TEXT:
        fits = ~F.contains(line, F.lit(":"))
        return F.when(fits & ~line.rlike(f"(?U){f.not_next}") if f.not_next else fits, line)
    fits = line.rlike(f"^{f.kind}+$")
    return F.when(fits, F.nullif(parse_number(line), F.lit(0).cast("bigint")) if f.kind == AMOUNT else line)


def cover_meta(lines: DataFrame, upazilas: dict[str, list[str]] | None = None, fields: list[Field] = COVER) -> DataFrame:
    """One row per document: the fields of its cover, from the lines (doc, line, text) of its first page."""
    in_order = Window.partitionBy("doc").orderBy("line")
    rows = lines.select("doc", "line", strip(text("text")).alias("_t")).filter("_t <> ''")
    reach = max(f.reach for f in fields)
    rows = rows.withColumns({f"_t{k}": F.lead("_t", k).over(in_order) for k in range(1, reach + 1)})
    at, line = F.col("line"), F.col("_t")
    first = lambda v, *rank: F.min(F.when(v.isNotNull(), F.struct(at.alias("at"), *[F.lit(r).alias("rank") for r in rank], v.alias("v"))))
    last = lambda v: F.max(F.when(v.isNotNull(), F.struct(at.alias("at"), v.alias("v"))))
    found = []
    for f in fields:
        hit = line.rlike(f"(?U){f.named or f.label}") & (~line.rlike(f"(?U){f.never}") if f.never else F.lit(True))
        here = F.when(hit, _value(f, line))
        ahead = F.when(hit & here.isNull(), F.coalesce(*[_follows(f, F.col(f"_t{k}")) for k in range(1, f.reach + 1)])) if f.reach else F.lit(None).cast("bigint" if f.kind == AMOUNT else "string")
        if f.last:
            found += [last(here).alias(f"_{f.name}"), first(here).alias(f"_{f.name}_first"), first(ahead).alias(f"_{f.name}_ahead")]
        else:
            found.append(first(F.coalesce(here, ahead), 0).alias(f"_{f.name}"))
    post = F.when(line.rlike(f"(?U){POST_OFFICE.named}"), _value(POST_OFFICE, line))
    listed = F.when(F.contains(line, F.lit(LIST)), F.when(F.contains(line, F.lit(FEMALE)), FEMALE).when(F.contains(line, F.lit(MALE)), MALE))
    covers = rows.groupBy("doc").agg(*found, first(post, 1).alias("_post"), last(listed).alias("_listed"))
    out, said = [], []
    for f in fields:
        none = F.lit(0).cast("bigint") if f.kind == AMOUNT else F.lit("")
        if f.last:
            out.append(F.coalesce(f"_{f.name}.v", f"_{f.name}_ahead.v", none).alias(f.name))
        elif f.name == POST_OFFICE.name:
            out.append(F.coalesce(F.least(f"_{f.name}", "_post")["v"], none).alias(f.name))
        else:
            out.append(F.coalesce(f"_{f.name}.v", none).alias(f.name))
        if f.gender:
            # A value on a later line counts only where none was known by then.
            early = F.when(F.coalesce(F.col(f"_{f.name}_first.at") > F.col(f"_{f.name}_ahead.at"), F.lit(True)), F.col(f"_{f.name}_ahead.at"))
            when = F.greatest(f"_{f.name}.at", early)
            said.append(F.when(when.isNotNull(), F.struct(when.alias("at"), F.lit(len(said)).alias("rank"), F.lit(f.gender).alias("v"))))
    said.append(F.when(F.col("_listed").isNotNull(), F.struct(F.col("_listed.at").alias("at"), F.lit(len(said)).alias("rank"), F.col("_listed.v").alias("v"))))
    covers = covers.select("doc", *out, F.coalesce(F.greatest(*said)["v"], F.lit(MALE)).alias("gender"))
    for district, names in (upazilas or {}).items():
        covers = covers.withColumn("upazila", F.when(F.col("district") == district, contained_entry("upazila", names)).otherwise(F.col("upazila")))
    return covers


# Register entries

#: A marker, and one that ends what stands before it.
MARKER, STRONG = f"(?U)^\\s*({DIGIT}{{2,4}})\\.[\\s{DANDA}]*(?:নাম\\s*[:{DANDA}]\\s*)?(.+)", f"(?U)^\\s*{DIGIT}{{2,4}}\\.[\\s{DANDA}]"
DAY = f"{DIGIT}{{1,2}}/{DIGIT}{{1,2}}/{DIGIT}{{4}}"
LOOK_AHEAD, PER_PAGE, NAME_ROOM = 12, 15, 40
#: Words around a date of birth, misreadings among them.
DATE_WORDS = "(?:জন্ম|তারিখ|তািরখ|জহ্ল|জিহ্ম|তাং)"


@dataclass(frozen=True)
class Label:
    """A field of an entry: a line that holds ``word`` (and not ``never``) and no label before it in the list has the value behind it, up to ``until``."""

    name: str
    word: str
    value: str = ".+"
    behind: str = f"\\s*[:{DANDA}]*\\s*"
    until: str = ""
    never: str = ""
    room: int = 1 << 30

    def hit(self, line: Column) -> Column:
        found = line.rlike(f"(?U){self.word}")
        return found & ~F.contains(line, F.lit(self.never)) if self.never else found

    def of(self, line: Column) -> Column:
        """null where nothing follows the label."""
        found = F.regexp_extract(line, f"(?U){self.word}{self.behind}({self.value})", 1)
        return F.when(found != "", strip(F.regexp_replace(found, f"(?:{self.until}).*", "") if self.until else found))


#: The labels of an entry's lines, in the order in which a line is tried.
LABELS = [
    Label("number", "(?:ভোটার|ভাটার)\\s*(?:নং|নম্বর)", value=f"{DIGIT}+"),
    Label("father", "পিতা", never="মাতা", until="মাতা|পেশা", room=80),
    Label("mother", "মাতা", until="পেশা", room=80),
    Label("occupation", "পেশা", behind=f"\\s*[:{DANDA},]*\\s*", room=50),
    Label("dob", "জন্ম\\s*তারিখ"),
    Label("address", f"ঠিকানা\\s*[:{DANDA}]", behind="\\s*"),
]
RECORD_SCHEMA = "doc string, serial string, serial_num int, serial_on_page int, name string, number string, father string, mother string, occupation string, dob string, address string, page int, x double, y double, width double, height double"


def numbered_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_at`` (the line's number in its document) and ``_run`` (strong markers up to it): counted within pages, then added up over the pages."""
    within, pages = Window.partitionBy("doc", "page").orderBy(*order), Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    strong = F.coalesce(text("text").rlike(STRONG), F.lit(False)).cast("int")
    rows = lines.withColumns({"_in": F.row_number().over(within), "_strong": F.sum(strong).over(within)})
    counts = rows.groupBy("doc", "page").agg(F.count("*").alias("_n"), F.max("_strong").alias("_m"))
    before = counts.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), F.coalesce(F.sum("_n").over(pages), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_m").over(pages), F.lit(0)).alias("_m0"))
    joined = rows.join(before, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("page") == F.col("_p")))
    return joined.withColumns({"_at": F.col("_n0") + F.col("_in"), "_run": F.col("_m0") + F.col("_strong")}).drop("_in", "_strong", "_d", "_p", "_n0", "_m0")


def entry_lines(numbered: DataFrame) -> DataFrame:
    """The lines of entries, with ``_start`` (the line number of their marker)."""
    serial = parse_number(F.regexp_extract(text("text"), MARKER, 1))
    rows = numbered.withColumn("_marks", text("text").rlike(MARKER) & (serial > 0))
    marks = rows.filter("_marks").groupBy("doc", "_run").agg(F.array_sort(F.collect_list("_at")).alias("_all"))
    # Of the markers between two strong ones, each that no entry before it reaches.
    taken = F.aggregate("_all", F.array().cast("array<bigint>"), lambda got, at: F.when((F.size(got) == 0) | (at > F.try_element_at(got, F.lit(-1)) + LOOK_AHEAD), F.concat(got, F.array(at))).otherwise(got))
    starts = marks.select(F.col("doc").alias("_d"), F.col("_run").alias("_r"), F.explode(taken).alias("_start"))
    # Each entry asks for the lines within its reach by their numbers, so no run is paired with itself.
    wanted = starts.withColumn("_l", F.explode(F.sequence(F.col("_start"), F.col("_start") + LOOK_AHEAD)))
    return rows.join(wanted, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("_at") == F.col("_l")) & (F.col("_run") == F.col("_r"))).drop("_d", "_r", "_l", "_marks")


def records(lines: DataFrame, first_page: int = 3, labels: list[Label] = LABELS) -> DataFrame:
    """Register entries from lines (doc, page, column, line, text, x, y, width, height) of the pages from ``first_page``."""
    used = lines.filter(F.col("page") >= first_page).select(F.col("doc").cast("string").alias("doc"), "page", "column", "line", text("text").alias("text"), "x", "y", "width", "height")
    rows = entry_lines(numbered_lines(used, ["column", "line"]))
    line, head = strip(F.col("text")), F.col("_at") == F.col("_start")
    kind = F.when(head, F.lit("head"))
    for label in labels:
        kind = kind.when(label.hit(line), F.lit(label.name))
    rows = rows.withColumns({"_t": line, "_kind": kind.otherwise(F.when(line.rlike("(?U)^[ঀ-৿\\s]+$"), F.lit("more")))})
    day = F.nullif(date_token("_t"), F.lit(""))
    job = F.regexp_replace(F.regexp_replace(F.regexp_extract("_t", f"^(.*?){DAY}", 1), f"(?U)^(.*?)পেশা\\s*[:{DANDA},]*\\s*", "$1"), f"(?U){DATE_WORDS}[\\s:,{DANDA}]*", "")
    values = {label.name: F.when(F.col("_kind") == label.name, label.of(F.col("_t"))) for label in labels}
    values["occupation"] = F.when(F.col("_kind") == "occupation", F.when(day.isNotNull(), strip(F.regexp_replace(job, f"[,{DANDA}]+$", ""))).otherwise(values["occupation"]))
    values["dob"] = F.when(F.col("_kind").isin("occupation", "dob"), day)
    rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_name", F.when(F.col("_kind") == "head", clean_name_prefix(F.regexp_extract("text", MARKER, 2))))
    # A name goes on over the next lines until a number or a father is known, as long as it has room.
    so_far = Window.partitionBy("doc", "_start").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.col("_v_number").isNotNull() | (F.coalesce("_v_father", F.lit("")) != "")).over(so_far), F.lit(False))
    rows = rows.withColumn("_goes_on", (F.col("_kind") == "more") & ~known)
    length = F.coalesce(F.sum(F.when(F.col("_kind") == "head", F.length("_name")).when(F.col("_goes_on"), 1 + F.length("_t"))).over(so_far), F.lit(0))
    rows = rows.withColumn("_part", F.when(F.col("_kind") == "head", F.col("_name")).when(F.col("_goes_on") & (length < NAME_ROOM), F.col("_t")))
    latest = lambda n: F.coalesce(F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct("_at", f"_v_{n}")))[f"_v_{n}"], F.lit("")).alias(n)
    parts = F.array_sort(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("_at", "_part"))))
    marker = F.min(F.when(head, F.struct("text", "page", "x", "y", "width", "height")))
    whole = rows.groupBy("doc", "_start").agg(parts.alias("_parts"), marker.alias("_m"), *[latest(label.name) for label in labels])
    serial = F.regexp_extract("_m.text", MARKER, 1)
    whole = whole.withColumns({"serial": serial, "serial_num": parse_number(serial).cast("int"), "name": clean_name_prefix(F.array_join(F.transform("_parts", lambda p: p["_part"]), " "))})
    whole = whole.filter((F.length("name") > 1) & ((F.col("number") != "") | (F.col("father") != "") | (F.col("mother") != "")))
    cut = {label.name: F.substring(label.name, 1, label.room) for label in labels}
    return whole.select("doc", "serial", "serial_num", ((F.col("serial_num") - 1) % PER_PAGE + 1).alias("serial_on_page"), F.substring("name", 1, 80).alias("name"), *[v.alias(n) for n, v in cut.items()], F.col("_m.page").cast("int").alias("page"), *[F.col(f"_m.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")])


def with_cover(found: DataFrame, cover: DataFrame, status: str = "সক্রিয়") -> DataFrame:
    """Entries with the places and dates of their document's cover, as the register prints them; the address falls back to the places."""
    c = cover.select(F.col("doc").cast("string").alias("doc"), "district", "upazila", "union_name", "ward_no", "area", "area_no", "gender", "published", "post_code")
    out = found.join(c, "doc", "left")
    places = F.concat_ws(", ", *[F.nullif(text(x), F.lit("")) for x in ("area", "upazila", "district")])
    return out.withColumn("address", first_filled("address", places)).withColumn("village", text("area")).withColumn("gender", F.when(F.col("gender") == FEMALE, FEMALE).otherwise(MALE)).withColumn("status", F.lit(status))

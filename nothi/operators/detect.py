"""Checks of document blobs and classification of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLED_PAGES = 5
#: Parts of font names that tell an encoding.
LEGACY_FONTS, UNICODE_FONTS = ("sutonny", "bijoy"), ("nikosh", "solaiman", "kalpurush", "vrinda", "siyam")


def integrity(content: Column | str) -> Column:
    """valid, error and version of a PDF blob."""
    c = F.col(content) if isinstance(content, str) else content
    n = F.coalesce(F.octet_length(c), F.lit(0))
    head = F.decode(F.substring(c, 1, 16), "ISO-8859-1")
    error = F.when(n < 10, "too small").when(~head.startswith("%PDF-"), "no PDF header").when(n < 200, "truncated")
    return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(error.isNull(), F.regexp_extract(head, "^%PDF-([0-9.]+)", 1)).otherwise("").alias("version"))


def accepted_uploads(files: DataFrame, most: int = 50 << 20) -> DataFrame:
    """Files (name, mime, length) that are PDFs by type or name and not too large."""
    return files.filter((F.col("length") <= most) & ((F.col("mime") == "application/pdf") | F.lower(F.col("name")).endswith(".pdf")))


def profile(items: DataFrame, by: list[str], column: str = "str") -> DataFrame:
    """Counts by class of character."""
    n = lambda chars: F.sum(F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(chars))).cast("long")
    return items.groupBy(*by).agg(F.sum(F.length(F.coalesce(F.col(column), F.lit("")))).cast("long").alias("chars"), n("[ঀ-৿]").alias("bengali"), n("[À-ɏ]").alias("latin_extended"), n("[\u0080-¿]").alias("control"))


def _has(fonts: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(fonts, lambda f: F.lower(f).rlike("|".join(parts)))


def classify(items: DataFrame) -> DataFrame:
    """doc, kind, encoding, confidence by the first pages' characters and fonts (doc, page, str, font)."""
    sample = items.filter((F.col("page") <= SAMPLED_PAGES) & (F.length("str") > 0))
    full = sample.groupBy("doc", "page").agg(F.sum(F.length("str")).alias("n")).filter("n > 10").groupBy("doc").agg(F.count("*").alias("pages"))
    fonts = sample.groupBy("doc").agg(F.sort_array(F.collect_set("font")).alias("fonts"))
    p = profile(sample, ["doc"]).join(full, "doc", "left").join(fonts, "doc").withColumn("pages", F.coalesce("pages", F.lit(0)))
    share = lambda c: F.col(c) / F.greatest("chars", F.lit(1))
    legacy, unicode_ = _has(F.col("fonts"), LEGACY_FONTS), _has(F.col("fonts"), UNICODE_FONTS)
    r = lambda kind, encoding, confidence: F.struct(F.lit(kind).alias("kind"), (encoding if isinstance(encoding, Column) else F.lit(encoding)).alias("encoding"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))
    per_page = F.when(F.col("pages") > 0, F.col("chars") / F.greatest("pages", F.lit(1))).otherwise(0.0)
    result = (
        F.when((per_page < 30) & (F.col("pages") < 2), r("scanned", "unknown", 0.9))
        .when(legacy & ~unicode_, r("legacy_font", F.when(_has(F.col("fonts"), ("bijoy",)), "bijoy").otherwise("sutonny"), 0.98))
        .when(unicode_ & ~legacy, r("text", "unicode", 0.95))
        .when((share("latin_extended") > 0.03) | (share("control") > 0.02), r("legacy_font", "sutonny", F.least(F.lit(0.95), 0.5 + share("latin_extended") * 3 + share("control") * 5)))
        .when(share("bengali") > 0.3, r("text", "unicode", 0.85))
        .when(share("bengali") > 0.1, r("text", "unicode", 0.7))
        .otherwise(r("legacy_font", "sutonny", 0.6))
    )
    return p.select("doc", "chars", "bengali", "latin_extended", "control", "pages", "fonts", result.alias("_r")).select("doc", "chars", "bengali", "latin_extended", "control", "pages", "fonts", "_r.kind", "_r.encoding", "_r.confidence")


def hex_dump(items: DataFrame, column: str = "str", n: int = 32) -> DataFrame:
    """The first characters of each item as code units, for diagnosis."""
    return items.withColumn("hex", F.hex(F.encode(F.left(F.col(column), F.lit(n)), "UTF-16BE")))

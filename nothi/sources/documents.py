"""Documents to text items through readers that the user brings.

A reader is a function from a file's bytes to pages: lists of items (str, x, y, width, height, font). No PDF or recognition library is assumed;
``capabilities`` says which are there. A document whose reader fails gives one row with the error and no items, and stays in the tables of documents.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS = "doc string, page int, seq int, str string, x double, y double, width double, height double, font string, error string"
_NAMES = [c.split()[0] for c in ITEMS.split(", ")]
OCR_PAGES = 30
#: Items that go back from Python at once.
ROWS_TOGETHER = 8192


def capabilities(modules: tuple[str, ...] = ("pypdf", "pdfplumber", "fitz", "pytesseract")) -> dict[str, bool]:
    return {m: importlib.util.find_spec(m) is not None for m in modules}


def read_items(blobs: DataFrame, reader: Callable[[bytes], list[list[tuple]]], most_pages: int | None = None, skipped: tuple[int, ...] = (2,)) -> DataFrame:
    """Items of blobs (doc, content), a document at a time; pages count from 1 and keep their numbers."""

    def rows(doc: str, content: bytes) -> Iterator[tuple]:
        try:
            for page, items in enumerate(reader(content)[:most_pages], 1):
                if page not in skipped:
                    for seq, item in enumerate(items):
                        yield (doc, page, seq, *item, None)
        except Exception as e:  # noqa: BLE001
            yield (doc, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")

    def frame(held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(held, columns=_NAMES).astype({"page": "Int32", "seq": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            for doc, content in zip(pdf["doc"], pdf["content"]):
                for row in rows(doc, bytes(content)):
                    held.append(row)
                    if len(held) >= ROWS_TOGETHER:
                        yield frame(held)
                        held = []
        if held:
            yield frame(held)

    return blobs.select(F.col("doc").cast("string").alias("doc"), "content").mapInPandas(run, ITEMS)


def recognised_text(blobs: DataFrame, recognise: Callable[[bytes], list[str]] | None, most_pages: int = OCR_PAGES) -> DataFrame:
    """doc and text of scanned documents; failed pages give empty texts, and without a recogniser every text is empty. No records are made of it."""
    if recognise is None:
        return blobs.select("doc", F.lit("").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                try:
                    texts.append("\n".join(recognise(bytes(content))[:most_pages]))
                except Exception:  # noqa: BLE001
                    texts.append("")
            yield pd.DataFrame({"doc": pdf["doc"], "text": texts})

    return blobs.select(F.col("doc").cast("string").alias("doc"), "content").mapInPandas(run, "doc string, text string")


def parse_status(blobs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """doc, records and error of every document; those that could not be read have none and stay."""
    errors = items.filter("error is not null").select("doc", "error").dropDuplicates(["doc"])
    counts = found.groupBy("doc").agg(F.count("*").alias("records"))
    return blobs.select(F.col("doc").cast("string").alias("doc")).join(counts, "doc", "left").join(errors, "doc", "left").select("doc", F.coalesce("records", F.lit(0)).alias("records"), "error")

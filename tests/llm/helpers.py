"""Small tables with everything that is awkward."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (5, "one two three four five six seven", "en", "a", 0),
    (3, None, None, None, None),
    (7, "", "en", "a", 0),
    (1, "One two three four five six SEVEN", "de", "b", 1),
    (1, "One two three four five six SEVEN", "de", "b", 1),
    (None, "one two three four five six seven", "en", "a", 3),
    (9, LONG, "fr", "c", 9),
    (2, "ä é\t\n  x<|endoftext|> 中文   y", "es", "a", 4),
    (4, "   \t\n", "en", "a", 5),
]


def docs(spark, rows=None, extra=True):
    """Documents with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ROWS if rows is None else rows, DOCS)
    if extra:
        df = df.selectExpr("*", "'x' as rep", "1 as f0", "'y' as shard", "cast(2 as double) as p", "'z' as token_count", "array(1) as ids", "'k' as key", "1 as score", "'c' as curve")
    return df


def empty(spark):
    return docs(spark, [])

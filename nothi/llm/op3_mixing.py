"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic). The cells' weights are raked to the target shares of
each margin in turn until all agree (``rake`` warns, with the largest difference, if they do not after ``ROUNDS`` rounds, as with targets that no weights can meet); then each document is kept with its cell's probability, by a number that its
doc_id fixes. The probability is ``keep`` times weight over tokens, and 1 where a cell has fewer tokens than its weight asks for. All of it is
DataFrame operations; the rounds run over cells, a table that is cut from its lineage by a write to the shared folder.

Targets default to smoothed shares of the corpus: a margin's share to the power ``smoothing``, made to add up to one.
Tokens are runs of characters between white space. The topic is a rule on the text (``topic``) unless the table has a
column for it. Null categories are a category of their own, null texts have no tokens and are kept with their cell's
probability; very long texts are read whole by native functions. Rows with a null doc_id draw the number of the empty id, repeated rows draw the same number. An empty table gives no row.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.llm import common

MARGINS = ("source", "lang", "topic")
SMOOTHING, KEEP, ROUNDS, CLOSE, AGREE = 0.85, 0.5, 30, 1e-12, 1e-6
#: What a cell that no target knows is called.
NONE = "(none)"


def topic(text: Column) -> Column:
    """A coarse topic by the shape of the text."""
    return (
        F.when(text.contains(" | "), "table").when(text.rlike("(?i)licen[sc]e|copyright"), "legal").when(text.rlike("[#$%&*]{3}"), "noisy").when(F.length(text) < 400, "note").when(F.length(text) < 4000, "article").otherwise("long")
    )


def _keys(docs: DataFrame) -> list[Column]:
    """source, lang, topic and u, the number in [0, 1) that decides."""
    own = F.col("topic").cast("string") if "topic" in docs.columns else topic(F.coalesce(F.col("text"), F.lit("")))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return [*[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")], F.coalesce(own, F.lit(NONE)).alias("topic"), draw.alias("u")]


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, u and tokens."""
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^ \t\n\r]+")).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(docs), tokens.alias("tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))


def smoothed_targets(cells: DataFrame, margin: str, smoothing: float = SMOOTHING) -> DataFrame:
    """The margin's values with their target shares."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(smoothing)).alias("s"))
    whole = sums.agg(F.sum("s")).head()[0] or 1.0
    return sums.select(margin, (F.col("s") / whole).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """Cells with ``w``, which sum to all tokens, and ``p``: the share of their tokens to keep.

    ``cells`` has the margins and ``tokens``; ``targets`` a table (margin, target) for each margin.
    """
    cells = common.materialize(cells.filter("tokens > 0"), "cells")
    whole = cells.agg(F.sum("tokens")).head()[0] or 0.0
    targets = {m: common.materialize((targets or {}).get(m) or smoothed_targets(cells, m), f"target_{m}") for m in MARGINS}
    for m in MARGINS:
        cells = cells.join(targets[m].withColumnRenamed("target", f"t_{m}"), m, "left")
    now = common.materialize(cells.select(*MARGINS, "tokens", *[F.coalesce(f"t_{m}", F.lit(0.0)).alias(f"t_{m}") for m in MARGINS], F.col("tokens").alias("w")), "cells")
    for _ in range(rounds):
        step = now.withColumn("was", F.col("w"))
        for m in MARGINS:
            sums = step.groupBy(m).agg(F.sum("w").alias("sum"))
            step = step.join(sums, m).withColumn("w", F.expr(f"coalesce(w * (t_{m} * {whole!r}D) / nullif(sum, 0.0D), 0.0D)")).drop("sum")
        now = common.materialize(step.select(*MARGINS, "tokens", *[f"t_{m}" for m in MARGINS], "w", F.expr("abs(w - was) / greatest(was, w, 1e-300D)").alias("moved")), "cells")
        if (now.agg(F.max("moved")).head()[0] or 0.0) < close:
            break
        now = now.drop("moved")
    far = margins(now, whole).agg(F.max(F.abs(F.col("share") - F.col("target")))).head()[0] or 0.0
    if whole and far > AGREE:
        warnings.warn(f"the margins do not agree after {rounds} rounds: a share is {far:.2g} from its target", stacklevel=2)
    return now.select(*MARGINS, "tokens", "w", F.least(F.lit(1.0), keep * F.col("w") / F.col("tokens")).alias("p"))


def margins(raked: DataFrame, whole: float, weight: str = "w") -> DataFrame:
    """margin, value, target and share: what the weights give each value, beside its target."""
    of = lambda m: raked.groupBy(F.lit(m).alias("margin"), F.col(m).alias("value")).agg(F.first(f"t_{m}").alias("target"), (F.sum(weight) / (whole or 1.0)).alias("share"))
    return of("source").union(of("lang")).union(of("topic"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """Units with p and kept. The documents are read twice; between, only cells are held."""
    rows = units(docs)
    joined = rows.join(rake(cells_of(rows), targets, keep).select(*MARGINS, "p"), list(MARGINS), "left").withColumn("p", F.coalesce("p", F.lit(keep)))
    return joined.withColumn("kept", F.col("u") < F.col("p"))


def sample_mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """The documents (all columns) that the mixture keeps."""
    cells = rake(cells_of(units(docs)), targets, keep).select(*[F.col(m).alias(f"__cell_{m}") for m in MARGINS], F.col("p").alias("__cell_p"))
    joined = docs.withColumn("__cell", F.struct(*_keys(docs))).join(cells, [F.col(f"__cell.{m}") == F.col(f"__cell_{m}") for m in MARGINS], "left")
    return joined.filter(F.col("__cell.u") < F.coalesce("__cell_p", F.lit(keep))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "lang", "topic", F.col("tokens").cast("long").alias("tokens"), F.round("p", 6).alias("p"), "kept")


_SUMS = "sum(w) OVER (PARTITION BY {0})"


def _sql() -> str:
    """The same rounds as a recursive query; every round is run."""
    step = "cells_k"
    for m in MARGINS:
        step = f"(SELECT * REPLACE (coalesce(w * (t_{m} * whole) / nullif(s, 0), 0) AS w) FROM (SELECT *, {_SUMS.format(m)} AS s FROM (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, whole, w, k FROM {step})))"
    share = lambda m: f"(SELECT {m}, s / sum(s) OVER () AS t_{m} FROM (SELECT {m}, pow(sum(tokens), {SMOOTHING}) AS s FROM cells GROUP BY {m}))"
    return f"""
WITH RECURSIVE u AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    CASE WHEN contains(t, ' | ') THEN 'table' WHEN regexp_matches(t, '(?i)licen[sc]e|copyright') THEN 'legal'
      WHEN regexp_matches(t, '[#$%&*]{{3}}') THEN 'noisy' WHEN length(t) < 400 THEN 'note' WHEN length(t) < 4000 THEN 'article' ELSE 'long' END AS topic,
    CAST(len(regexp_extract_all(t, '[^ \t\n\r]+')) AS DOUBLE) AS tokens,
    CAST(('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / CAST({1 << 52} AS DOUBLE) AS u
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)),
cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM u GROUP BY ALL HAVING sum(tokens) > 0),
cells_k AS (
  SELECT c.source, c.lang, c.topic, c.tokens, t_source, t_lang, t_topic, (SELECT sum(tokens) FROM cells) AS whole, c.tokens AS w, 0 AS k
  FROM cells c JOIN {share('source')} USING (source) JOIN {share('lang')} USING (lang) JOIN {share('topic')} USING (topic)
  UNION ALL
  SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, whole, w, k + 1 FROM {step} WHERE k < {ROUNDS})
SELECT doc_id, u.source, u.lang, u.topic, CAST(u.tokens AS BIGINT) AS tokens, round(coalesce(p, {KEEP}), 6) AS p, u.u < coalesce(p, {KEEP}) AS kept
FROM u LEFT JOIN (SELECT *, least(1, {KEEP} * w / tokens) AS p FROM cells_k WHERE k = {ROUNDS}) c ON u.source = c.source AND u.lang = c.lang AND u.topic = c.topic
"""


SQL = _sql()

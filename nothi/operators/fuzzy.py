"""Fuzzy lookup with an index: the entries of a lookup that are alike a word, without comparing every word with every entry.

Two texts are alike above a threshold if few edits part them, and how many follows from the longer one's length. Up to ``WHOLE`` edits leave the two texts with a common rest, which is each of
them without as many characters at most; so a text stands in the index with all its rests, and few texts but the near ones share a rest. With more edits a text is cut into so many parts
that one has a single edit at most and is moved no farther than the edits before and after it allow; an entry is indexed by the rests of its parts, and a word asks with its own substrings at
the places where a part may lie. An equi join on a hash of the rest finds every pair; nothing is compared by distance but what it finds.

Only the nearest entry counts for a plain lookup in a table. So words that are entries themselves are done at once, then those with an entry at one edit, at two and so on (``DEEP``), each by rests of whole texts; what is asked
by parts, which many texts share, is what is left and only against entries that are long enough for more edits.

Both sides are tables: a small index is broadcast, a large one is shuffled, and Spark splits what is skewed. Lists of entries become a table of
checked size (``MOST``) first. Nothing of a lookup stands in the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nothi.functions.bengali import skeleton
from nothi.functions.similarity import similarity
from nothi.sources import scratch

#: Entries that a list may have: its index is broadcast.
MOST = 10_000
#: Edits up to which whole texts are asked by their rests.
WHOLE = 2
#: The same for a lookup in a table, if no text has more than so many rests with it.
DEEP, RESTS = 4, 13_000
_SLACK = 1e-9


def entries_table(spark: SparkSession, entries: list[str] | DataFrame) -> DataFrame:
    """o (the place of an entry, by which the first of equals wins), entry. A DataFrame has ``entry`` and perhaps ``o``; without it entries stand in their own order."""
    if isinstance(entries, DataFrame):
        return entries.select((F.col("o") if "o" in entries.columns else F.col("entry")).alias("o"), "entry").filter("entry is not null")
    if len(entries) > MOST:
        raise ValueError(f"a list of entries may have {MOST} at most; give a DataFrame")
    return F.broadcast(spark.createDataFrame(list(enumerate(entries)), "o int, entry string"))


def edits(longer: Column, threshold: float) -> Column:
    """Edits of two texts that are alike above the threshold, at most: by the same arithmetic as ``similarity``."""
    most = F.greatest(F.ceil((1.0 - threshold) * longer + _SLACK) - 1, F.lit(0)).cast("int")
    return F.when((most > 0) & (1.0 - most / F.greatest(longer, F.lit(1)) <= threshold), most - 1).otherwise(most)


def _cut(i: Column, n: Column, parts: Column) -> Column:
    return F.floor(i * n / parts).cast("int")


def _rests(rows: DataFrame, most: Column, deep: int = WHOLE) -> DataFrame:
    """Adds ``_rest``: the text ``_s`` without no character or some, ``most`` and ``deep`` at most; ``_y`` is the last one's place from 1, ``_x`` and ``_x3`` those before it."""
    n, before, places = F.length("_s"), F.lit(0), []
    for k in range(deep, 0, -1):
        place = "_y" if k == 1 else "_x" if k == 2 else f"_x{k}"
        last = F.greatest(n - (k - 1), F.lit(0))
        rows = rows.withColumn(place, F.explode(F.when(before > 0, F.sequence(F.least(before + 1, last), last)).when(most >= k, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))))
        before = F.col(place)
        places.append(before)
    kept = [F.substring("_s", x + 1, y - x - 1) for x, y in zip([F.lit(0), *places], [*places, n + 1])]
    return rows.withColumn("_rest", F.concat(*kept))


def wholes(texts: DataFrame, column: str, threshold: float, *keep: str) -> DataFrame:
    """_key and the kept columns: the rests of whole texts that may differ by ``WHOLE`` edits at most."""
    out = texts.select(*keep, F.col(column).alias("_s")).withColumn("_t", edits(F.length("_s"), threshold)).filter(F.col("_t") <= WHOLE)
    return _rests(out, F.col("_t")).select(*keep, F.xxhash64("_rest").alias("_key"))


def _least_length(t: int, threshold: float) -> int | None:
    """The least length of the longer of two texts that differ by t edits and are alike, by the arithmetic of ``similarity``; null if none are."""
    if threshold >= 1:
        return None
    n = max(t, 1, math.floor(t / (1.0 - threshold)) - 2)
    while not 1.0 - t / n > threshold:
        n += 1
    return n


def _deep(threshold: float) -> int:
    """Edits up to which a lookup in a table asks by rests of whole texts."""
    most = lambda t: _least_length(t + 1, threshold) - 1 + t
    fits = [t for t in range(WHOLE, DEEP + 1) if threshold < 1 and sum(math.comb(most(t), k) for k in range(t + 1)) <= RESTS]
    return max(fits, default=WHOLE)


def rests(texts: DataFrame, column: str, threshold: float, edits_: int, most: int | None, *keep: str) -> DataFrame:
    """_key and the kept columns: the rests of whole texts of up to ``most`` characters, for pairs that are alike by so many edits. The longer one loses as many characters at most, the shorter one fewer by what it is shorter."""
    least, n = _least_length(edits_, threshold), F.length("_s")
    out = texts.select(*keep, F.col(column).alias("_s")).filter(n >= least - edits_)
    out = out if most is None else out.filter(n <= most)
    return _rests(out, F.least(F.lit(edits_), n - (least - edits_)), edits_).select(*keep, F.xxhash64("_rest").alias("_key"))


def _part(i: Column, n: Column, t: Column) -> tuple[Column, Column, Column]:
    """Where part i begins and ends, and how many there are: one of them has one edit at most."""
    parts = F.floor(t / 2).cast("int") + 1
    return _cut(i, n, parts), _cut(i + 1, n, parts), parts


def index(entries: DataFrame, column: str, threshold: float, *keep: str, over: int = WHOLE) -> DataFrame:
    """_key and the kept columns: the rests of the parts of each entry for every number of edits over ``over`` that it may be asked with."""
    b, t = F.col("_b"), F.col("_t")
    out = entries.select(*keep, F.col(column).alias("_text"), F.length(column).alias("_b"))
    longest = F.greatest(b, F.floor(b / threshold + _SLACK).cast("int"))
    out = out.withColumn("_t", F.explode(F.array_distinct(F.transform(F.sequence(b, longest), lambda n: edits(n, threshold))))).filter(t > over)
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor(t / 2).cast("int"))))
    begin, end, _ = _part(F.col("_i"), b, t)
    out = out.withColumn("_s", F.substring("_text", begin + 1, end - begin))
    return _rests(out, F.lit(1), 1).select(*keep, F.xxhash64("_b", "_t", "_i", "_rest").alias("_key"))


def asked(words: DataFrame, column: str, threshold: float, *keep: str, over: int = WHOLE) -> DataFrame:
    """_key and the kept columns: what each word looks for in the index."""
    a, b, t, i, delta = (F.col(c) for c in ("_a", "_b", "_t", "_i", "_d"))
    out = words.select(*keep, F.col(column).alias("_text"), F.length(column).alias("_a"))
    least, most = F.ceil(a * threshold - _SLACK).cast("int"), F.greatest(a, F.floor(a / threshold + _SLACK).cast("int"))
    out = out.filter(edits(most, threshold) > over).withColumn("_b", F.explode(F.sequence(least, most)))
    out = out.withColumn("_t", edits(F.greatest(a, b), threshold)).filter((t > over) & (F.abs(a - b) <= t))
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor(t / 2).cast("int")))).withColumn("_d", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    begin, end, parts = _part(i, b, t)
    # There is such a part with 2 i or 2 i + 1 edits before it, and the rest of them behind it; the first part has nothing before it, the last nothing behind.
    size, moved = end - begin + delta, a - b - delta
    before, behind = F.when(i == 0, 0).otherwise(F.least(2 * i + 1, t)), F.when(i == parts - 1, 0).otherwise(t - 2 * i)
    lo = F.greatest(F.lit(0), begin - before, begin + moved - behind)
    hi = F.least(a - size, begin + before, begin + moved + behind)
    out = out.withColumns({"_n": size, "_lo": lo, "_hi": hi}).filter("_n >= 0 and _lo <= _hi").withColumn("_p", F.explode(F.sequence("_lo", "_hi")))
    out = _rests(out.withColumn("_s", F.substring("_text", F.col("_p") + 1, F.col("_n"))), F.when(delta < 0, 0).otherwise(1), 1)
    return out.filter((delta < 1) | (F.col("_y") > 0)).select(*keep, F.xxhash64("_b", "_t", "_i", "_rest").alias("_key"))


def _met(asking: DataFrame, held: DataFrame, listed: bool) -> DataFrame:
    """Rows of both sides with one key. A list's index is broadcast. A table's is many times the table, so that its size says nothing, and few bytes make many pairs: both sides are dealt out by number."""
    if listed:
        return asking.join(F.broadcast(held), "_key").drop("_key")
    n = int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asking.repartition(n, "_key").join(held.repartition(n, "_key").hint("merge"), "_key").drop("_key")


def alike(words: DataFrame, column: str, entries: DataFrame, entry: str, threshold: float, words_keep: tuple[str, ...], entries_keep: tuple[str, ...], listed: bool = False) -> DataFrame:
    """Candidate pairs, with the kept columns of both sides; a pair may come more than once. ``listed``: the entries are few."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    whole = _met(wholes(words, column, threshold, *words_keep), wholes(entries, entry, threshold, *entries_keep), listed)
    return whole.unionByName(_met(asked(words, column, threshold, *words_keep), index(entries, entry, threshold, *entries_keep), listed))


def _scored(pairs: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """_asked and _m: of the pairs above the threshold that with the highest score, then the smallest place; with ``most``, only of pairs that differ by so many edits at most."""
    if most is not None:
        # A bounded distance is cheap, and few pairs are left to be sorted.
        pairs = pairs.filter(F.levenshtein("_asked", "entry", most) >= 0)
    # Filtered when it is the best, so that a distance is taken once.
    scored = pairs.select("_asked", "o", "entry", similarity(F.col("_asked"), F.col("entry")).alias("d"))
    return scored.groupBy("_asked").agg(F.min(F.struct((-F.col("d")).alias("d"), "o", "entry", F.lit("LEVENSHTEIN").alias("method"))).alias("_m")).filter(-F.col("_m.d") > threshold)


def _best(found: DataFrame) -> DataFrame:
    return found.select("_asked", F.struct(F.col("_m.entry").alias("match"), (-F.col("_m.d")).alias("score"), F.col("_m.method").alias("method")).alias("_best"))


def _nearest(distinct: DataFrame, column: str, words: DataFrame, listed: DataFrame, threshold: float) -> DataFrame:
    """``best_match`` against a table of entries: equal ones first, then those at one edit, at two and so on, then all others, each for the words that are left."""
    spark = words.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch.path(spark, name)
        # Small rows become many, so they are spread over tasks again when read.
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    listed = kept(listed.groupBy("entry").agg(F.min("o").alias("o")), "entries")
    same = F.struct((-F.lit(1.0)).alias("d"), "o", "entry", F.lit("LEVENSHTEIN").alias("method"))
    best = kept(words.join(listed, F.col("_asked") == F.col("entry"), "left").select("_asked", F.when(F.col("entry").isNotNull() & F.lit(threshold < 1), same).alias("_m")), "best")
    closed = F.col("_m").isNotNull()
    done, left, deep = [best.filter(closed)], best.filter(~closed), _deep(threshold)
    # What words of so many characters differ from by up to ``deep`` edits has few enough rests; longer ones ask by parts after the first edit.
    longest = _least_length(deep + 1, threshold) - 1 if threshold < 1 else 0
    later = []
    for t in range(1, deep + 1) if threshold < 1 else ():
        pairs = _met(rests(left, "_asked", threshold, t, None if t == 1 else longest, "_asked"), rests(listed, "entry", threshold, t, None if t == 1 else longest + t, "o", "entry"), False)
        best = kept(left.join(_scored(pairs, threshold, t).withColumnRenamed("_m", "_f"), "_asked", "left").select("_asked", F.least("_m", "_f").alias("_m")), "best")
        # t + 1 edits and more make one less (t + 1) / (n + t + 1) at best.
        closed = F.coalesce(-F.col("_m.d") > 1.0 - (t + 1) / (F.length("_asked") + t + 1), F.lit(False))
        done.append(best.filter(closed))
        left = best.filter(~closed)
        if t == 1:
            later, left = [left.filter(F.length("_asked") > longest)], left.filter(F.length("_asked") <= longest)
    for x in later:
        left = left.unionByName(x)
    far = _scored(_met(asked(left, "_asked", threshold, "_asked", over=deep), index(listed, "entry", threshold, "o", "entry", over=deep), False), threshold)
    found = left.join(far.withColumnRenamed("_m", "_f"), "_asked", "left").select("_asked", F.least("_m", "_f").alias("_m"))
    for x in done:
        found = found.unionByName(x)
    out = distinct.select(column).join(_best(found.filter("_m is not null")), F.col(column) == F.col("_asked"), "left")
    return _told(out, column, threshold)


def _told(out: DataFrame, column: str, threshold: float) -> DataFrame:
    return out.select(column, F.col("_best.match").alias("match"), F.coalesce("_best.score", F.lit(float(threshold))).alias("score"), F.coalesce("_best.method", F.lit("NONE")).alias("method"))


def _found(words: DataFrame, entries: list[str] | DataFrame, threshold: float, phonetic: bool, margin: float) -> DataFrame:
    """_asked and _best of the words (_asked) that have a match, by the index of all entries."""
    listed, few = entries_table(words.sparkSession, entries), not isinstance(entries, DataFrame)
    if not phonetic:
        return _best(_scored(alike(words, "_asked", listed, "entry", threshold, ("_asked",), ("o", "entry"), listed=few), threshold))
    # A text and its skeleton are two forms, one where they are equal: a pair is found by any two of them.
    listed = listed.withColumn("_ek", skeleton("entry")).withColumn("_form", F.explode(F.array_distinct(F.array("entry", "_ek"))))
    words = words.withColumn("_asked_key", skeleton("_asked")).withColumn("_as", F.explode(F.array_distinct(F.array("_asked", "_asked_key"))))
    pairs = alike(words, "_as", listed, "_form", threshold, ("_asked", "_asked_key"), ("o", "entry", "_ek"), listed=few)
    scored = pairs.select("_asked", "o", "entry", similarity(F.col("_asked"), F.col("entry")).alias("d"), similarity(F.col("_asked_key"), F.col("_ek")).alias("p"))
    scored = scored.filter((F.col("d") > threshold) | (F.col("p") > threshold + margin))
    if margin:
        start = F.struct(F.lit(None).cast("string").alias("match"), F.lit(float(threshold)).alias("score"), F.lit("NONE").alias("method"))

        def step(best: Column, x: Column) -> Column:
            now = F.when(x["d"] > best["score"], F.struct(x["entry"].alias("match"), x["d"].alias("score"), F.lit("LEVENSHTEIN").alias("method"))).otherwise(best)
            return F.when(x["p"] > now["score"] + margin, F.struct(x["entry"].alias("match"), x["p"].alias("score"), F.lit("PHONETIC").alias("method"))).otherwise(now)

        return scored.groupBy("_asked").agg(F.aggregate(F.array_sort(F.collect_set(F.struct("o", "entry", "d", "p"))), start, step).alias("_best"))
    # Without a margin that is the highest score, then the smallest place.
    by = F.when(F.col("p") > F.col("d"), F.struct((-F.col("p")).alias("d"), "o", "entry", F.lit("PHONETIC").alias("method"))).otherwise(F.struct((-F.col("d")).alias("d"), "o", "entry", F.lit("LEVENSHTEIN").alias("method")))
    return _best(scored.groupBy("_asked").agg(F.min(by).alias("_m")))


def matches(words: DataFrame, column: str, entries: list[str], threshold: float, phonetic: bool = False, margin: float = 0.0) -> DataFrame:
    """``best_match`` against a list, of the values that have a match only; ``words`` may repeat. What they ask is dealt out by number, and shares no task with the table of distinct values."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked_ = words.select(F.col(column).alias("_asked")).filter("_asked is not null").distinct().repartition(n, F.xxhash64("_asked"))
    found = _found(asked_, entries, threshold, phonetic, margin).filter("_best.match is not null")
    return _told(found.withColumnRenamed("_asked", column), column, threshold)


def best_match(distinct: DataFrame, column: str, entries: list[str] | DataFrame, threshold: float, phonetic: bool = False, margin: float = 0.0) -> DataFrame:
    """column, match, score, method of distinct values: the entry most alike, above the threshold; of equals the first.

    With ``phonetic``, entries are looked at in order, and one counts by its skeleton if that is more alike than the best so far by over ``margin``. An entry below the
    threshold in both ways never counts, so the entries found by the index, gone through in order, give what all would.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    words = distinct.select(F.col(column).alias("_asked")).filter("_asked is not null")
    if isinstance(entries, DataFrame) and not phonetic:
        return _nearest(distinct, column, words, entries_table(distinct.sparkSession, entries), threshold)
    out = distinct.select(column).join(_found(words, entries, threshold, phonetic, margin), F.col(column) == F.col("_asked"), "left")
    return _told(out, column, threshold)


def looked_up(df: DataFrame, column: str, pairs: dict[str, str] | DataFrame, out: str) -> DataFrame:
    """Adds ``out``: what a lookup (pairs, or a table of unique keys and values) has for the column; null if it has nothing."""
    if isinstance(pairs, DataFrame):
        table = pairs.toDF("_lk", out)
    else:
        if len(pairs) > MOST:
            raise ValueError(f"a lookup may have {MOST} pairs at most; give a DataFrame")
        table = F.broadcast(df.sparkSession.createDataFrame(list(pairs.items()), f"_lk string, `{out}` string"))
    return df.join(table, F.col(column) == F.col("_lk"), "left").drop("_lk")

"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets integer measures (per mille of words, lines or characters).
Per language and source a sketch counts the documents by measure value, the
value rounded down to its leading ``SKETCH_BITS`` bits: relative error below
2**(1-SKETCH_BITS), at most a few hundred bins, and two sketches merge by
adding counts, in any order, to the same result.  A document is rejected where
a measure lies outside fences ``q75 + reach * max(q75 - q25, slack)`` (and the
mirror image for the low side) of its own group.  Groups with fewer than
``min_docs`` documents use the merged sketch of their language, else of all.

Only DataFrame functions run here.

Defined results: null or blank texts have no words, fail the base rules and
are left out of the sketches, as are all other base failures; a null language
or source is a group of its own; repeated rows are judged alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import packed, row_key, small, stored, words

SKETCH_BITS = 6
WINDOW = 8          # words of a repeated window
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

#: measure -> (least spread that counts on the high side, same on the low side or None).
#: The spreads keep a group whose documents are all alike from rejecting small deviations.
MEASURES = {
    "symbols_pm": (40, None),      # symbols per 1000 words
    "dup_lines_pm": (200, None),   # repeated lines per 1000 lines
    "repeat_pm": (100, None),      # repeated-window words per 1000 words
    "upper_pm": (80, None),        # capital letters per 1000 word characters
    "word_len_cc": (150, 120),     # characters per 100 words
}
REACH = 3


def base_measures(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, key`` and the counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", "lang", "source", row_key(F.col("doc_id"), F.col("text")).alias("key"),
                       text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    step = step.select(
        "doc_id", "lang", "source", "key",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"))
    # hash of every window of 2, 4, 8 words by doubling; windows that start in the last words are cut off below
    for a, b, k in (("h1", "h2", 1), ("h2", "h4", 2), ("h4", "h8", 4)):
        step = step.withColumn(b, F.expr(f"transform({a}, (x, i) -> xxhash64(x, get({a}, i + {k})))"))
    n_windows = F.greatest(F.lit(0), F.size("h1") - F.lit(WINDOW - 1))
    step = step.withColumn("win", F.slice("h8", F.lit(1), n_windows))
    step = step.withColumn("has_repeat", F.size("win") > F.size(F.array_distinct("win")))
    # (hash, start) in hash order; a start belongs to a repeated window if a neighbour has its hash
    step = step.withColumn("runs", F.when(F.col("has_repeat"), F.array_sort(
        F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    def near(x: Column, j: Column) -> Column:
        return F.coalesce(F.get("runs", j)["h"] == x["h"], F.lit(False))
    repeated = F.filter("runs", lambda x, i: near(x, i - 1) | near(x, i + 1))
    step = step.withColumn("starts", F.array_sort(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - x,
                                                                             F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return step.select(
        "doc_id", "lang", "source", "key", "n_words", "word_chars", "n_symbols", "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("has_repeat"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def with_measures(counts: DataFrame) -> DataFrame:
    def per(a: str, factor: int, b: str) -> Column:
        return F.when(F.col(b) > 0, F.expr(f"{factor} * {a} div {b}")).otherwise(F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return counts.select(
        "*", failed.alias("base_failed"),
        per("n_symbols", 1000, "n_words").alias("symbols_pm"), per("n_dup_lines", 1000, "n_lines").alias("dup_lines_pm"),
        per("n_repeat_words", 1000, "n_words").alias("repeat_pm"), per("n_upper", 1000, "word_chars").alias("upper_pm"),
        per("word_chars", 100, "n_words").alias("word_len_cc"))


def sketch_bin(value: Column) -> Column:
    """The value with all but its leading SKETCH_BITS bits cleared."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - F.lit(SKETCH_BITS))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bin, n``: one mergeable sketch per language, source and measure."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), sketch_bin(F.col(m)).alias("bin"))
                                for m in MEASURES]))
    return (measured.where(~F.col("base_failed")).select("lang", "source", pairs.alias("m"))
            .groupBy("lang", "source", "m.measure", "m.bin").agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to ``keys`` and read the quartiles: ``keys, measure, n_docs, q25, q75``."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    seen = merged.select("*", F.sum("n").over(group).alias("total"),
                         F.sum("n").over(group.orderBy("bin")).alias("upto"))
    return seen.groupBy(*keys, "measure").agg(
        F.max("total").alias("n_docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q25"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q75"))


def thresholds(sketch: DataFrame, min_docs: int = 200) -> DataFrame:
    """``lang, source`` -> ``lo_<measure>, hi_<measure>`` (null: no such fence)."""
    levels = [quantiles(sketch, keys) for keys in (["lang", "source"], ["lang"], [])]
    own, lang, all_ = (q.select(*[F.col(c).alias(f"{c}_{i}") for c in q.columns]) for i, q in enumerate(levels))
    joined = (own.join(lang, F.expr("lang_0 <=> lang_1 and measure_0 = measure_1"), "left")
              .join(all_, F.expr("measure_0 = measure_2"), "left"))

    def pick(c: str) -> Column:
        return (F.when(F.col("n_docs_0") >= min_docs, F.col(f"{c}_0"))
                .when(F.col("n_docs_1") >= min_docs, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")))
    q25, q75 = pick("q25"), pick("q75")
    out = []
    for m, (high, low) in MEASURES.items():
        mine = F.col("measure_0") == m
        out.append(F.max(F.when(mine, q75 + REACH * F.greatest(q75 - q25, F.lit(high)))).alias(f"hi_{m}"))
        out.append(F.max(F.when(mine, q25 - REACH * F.greatest(q75 - q25, F.lit(low)) if low
                                else F.lit(None).cast("long"))).alias(f"lo_{m}"))
    return joined.groupBy(F.col("lang_0").alias("lang"), F.col("source_0").alias("source")).agg(*out)


def judge(docs: DataFrame, min_docs: int = 200) -> DataFrame:
    """One row per row of ``docs``: counts, measures, ``base_failed``, ``kept``, ``key``."""
    measured = stored(with_measures(base_measures(docs)), "quality-measures")
    fences = stored(thresholds(sketches(measured), min_docs), "quality-thresholds")
    fences = fences.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    outside = F.lit(False)
    for m, (_, low) in MEASURES.items():
        outside = outside | F.coalesce(F.col(m) > F.col(f"hi_{m}"), F.lit(False))
        if low:
            outside = outside | F.coalesce(F.col(m) < F.col(f"lo_{m}"), F.lit(False))
    joined = measured.join(small(fences), F.expr("lang <=> _lang and source <=> _source"), "left")
    return joined.select(*measured.columns, (~F.col("base_failed") & ~outside).alias("kept"))


def accepted(docs: DataFrame, min_docs: int = 200) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with all columns of ``docs`` (whatever their names)."""
    keyed = packed(docs).select("row", F.col("row.doc_id").alias("id"), F.col("row.lang").alias("l"), F.col("row.source").alias("s"),
                                row_key(F.col("row.doc_id"), F.col("row.text")).alias("k"))
    # a verdict is found by id, language and source as well as by the text's hash
    kept = judge(docs, min_docs).where("kept").select("doc_id", "lang", "source", "key")
    return keyed.join(kept, F.expr("id <=> doc_id and k = key and l <=> lang and s <=> source"), "left_semi").select("row.*")

"""Quality rules with adaptive thresholds (DataFrame functions only).

Base rules fail documents of under 50 words and those with over half their
words in repeated 3-word windows. What passes is judged by four ratios against
thresholds of its own language and source: symbols per character, duplicate
lines, repeated words (per mille) and word length (hundredths). The thresholds
come from quantile sketches: a histogram per (language, source, ratio) over
buckets with six significant bits (relative error under 1/32). Sketches merge by
adding counts, whatever the partitioning, so results don't depend on it, and a
hot source is pre-aggregated on the map side. A ratio may exceed the upper
quartile by three times the quartile range (or a least range, so that sources
where nearly all documents are clean don't reject their rest); word length has
such a fence on either side. Thresholds (one row per language and source) are
then joined to the documents.

Cases: a null text has no words and fails; null languages and sources are
groups of their own; repeated rows count each time; a group whose documents
all fail the base rules has no thresholds and keeps none; empty input gives an
empty result; other columns are carried by ``keep_good`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.common import SPACES, Stages, let, whole, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 3
#: Least quartile range taken for each ratio.
LEAST_RANGE = {"symbols": 20, "dup_lines": 150, "repeats": 150, "word_len": 50}
SYMBOLS = "[#*$%&|<>]"


def _covered(hashes: Column) -> Column:
    """Words covered by the 3-word windows whose hash occurs more than once."""
    def positions(s: Column) -> Column:
        return F.sort_array(F.transform(
            F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])), lambda e: e["i"]))

    def span(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))),
                           F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
        let(let(ordered, positions), span)).cast("long")


def n_repeat_words(ws: Column) -> Column:
    windows = F.when(F.size(ws) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))))
    return let(windows, _covered)


def counts(text: Column) -> Column:
    """A struct of the base counts of a non-null text, all long."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_word = let(words(text), lambda w: F.struct(
        F.size(w).alias("n"), n_repeat_words(w).alias("r"), F.char_length(F.array_join(w, "")).alias("c")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return let(F.struct(by_word.alias("w"), by_line.alias("l")), lambda x: F.struct(
        x["w"]["n"].cast("long").alias("n_words"), x["w"]["c"].cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (x["l"]["n"] - x["l"]["d"]).cast("long").alias("n_dup_lines"), x["w"]["r"].alias("n_repeat_words"),
        x["l"]["n"].cast("long").alias("n_lines")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The judged ratios, as whole numbers, of documents with a word."""
    return {"symbols": F.expr("1000 * n_symbols div word_chars"), "dup_lines": F.expr("1000 * n_dup_lines div n_lines"),
            "repeats": F.expr("1000 * n_repeat_words div n_words"), "word_len": F.expr("100 * word_chars div n_words")}


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): mergeable quantile sketches of documents that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), v.alias("v")) for k, v in ratios().items())))
    # The counts repeat much: those of equal documents are summed first.
    passed = counted.filter(~base_failed()).select("lang", "source", each.alias("e")).select("lang", "source", "e.*")
    bucket = F.expr("v - v % shiftleft(1L, greatest(length(bin(v)) - 6, 0))")
    return passed.groupBy("lang", "source", "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): the highest allowed value of each ratio, and the least word length."""
    w = Window.partitionBy("lang", "source", "ratio")
    run = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    q = run.groupBy("lang", "source", "ratio").agg(
        F.min(F.when(F.expr("4 * upto >= all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.expr("4 * upto >= 3 * all"), F.col("bucket"))).alias("q3"))
    at = lambda k, c: F.max(F.when(F.col("ratio") == k, c))
    fence = lambda k: FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_RANGE[k]))
    return q.groupBy("lang", "source").agg(
        *(at(k, F.col("q3") + fence(k)).alias(f"max_{k}") for k in LEAST_RANGE),
        at("word_len", F.col("q1") - fence("word_len")).alias("min_word_len"))


def verdict(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with base_failed and kept, by a join on language and source."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    r = ratios()
    good = F.lit(True)
    for k, v in r.items():
        good = good & (v <= F.col(f"max_{k}"))
    good = good & (r["word_len"] >= F.col("min_word_len"))
    return counted.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left") \
        .withColumn("base_failed", base_failed()).withColumn("kept", F.when(base_failed(), False).otherwise(F.coalesce(good, F.lit(False))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang, source, the counts, base_failed, kept, and the thresholds that were used."""
    stages = Stages(docs.sparkSession)
    counted = stages.write(docs.select(F.col(id_col).alias("id"), "lang", "source", counts(whole(text_col)).alias("c"))
                           .select("id", "lang", "source", "c.*"), "counts")
    limits = stages.write(thresholds(sketches(counted)), "limits", 1)
    return verdict(counted, limits).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. The thresholds need a pass
    over the counts first; the second pass counts again rather than storing texts."""
    stages = Stages(docs.sparkSession)
    counted = docs.select("lang", "source", F.struct("*").alias("row"), counts(whole(text_col)).alias("c"))
    limits = stages.write(thresholds(sketches(counted.select("lang", "source", "c.*"))), "limits", 1)
    return verdict(counted.select("lang", "source", "row", "c.*"), limits).filter("kept").select("row.*")

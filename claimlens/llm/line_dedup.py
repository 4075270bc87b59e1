"""Removal of lines that spread over many distinct sites (DataFrame functions only).

Lines are known by two 64-bit hashes. A first count leaves those that occur
``MIN_SITES`` times or more; only they get a HyperLogLog sketch of their sites,
merged by aggregation (map side first, so a line of a third of all documents
costs a sketch a task). Lines whose estimate is near ``MIN_SITES`` get an exact
count of distinct sites; clear ones don't. What spreads over ``MIN_SITES`` sites
or more is boilerplate and goes from every document; the lines that stay are
joined by line feeds again.

Cases: null text is empty; blank lines are never removed; a null site is a site
of its own; repeated rows are treated alike; a text of boilerplate only becomes
empty; empty input gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import SPACES, Stages, let, whole

MIN_SITES = 8
#: log2 of a sketch's registers; its standard error is 1.04 / sqrt(registers).
LOG_REGISTERS = 10
#: Estimates within so many standard errors (and 1) of MIN_SITES are counted exactly.
ERRORS = 5


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def spread_lines(lines: DataFrame, stages: Stages, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of lines on ``min_sites`` distinct sites or more; ``lines`` has h1, h2, site."""
    key = ["h1", "h2"]
    often = lines.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select(*key)
    some = lines.join(often, key, "left_semi")
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit(""))
    about = stages.write(some.groupBy(*key).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(site, LOG_REGISTERS)).alias("about")), "about")
    margin = max(1, math.ceil(ERRORS * 1.04 / math.sqrt(2 ** LOG_REGISTERS) * min_sites))
    near = about.filter(F.abs(F.col("about") - min_sites) <= margin).select(*key)
    exact = some.join(near, key, "left_semi").select(*key, site.alias("site")).distinct().groupBy(*key).agg(F.count("*").alias("n")) \
        .filter(F.col("n") >= min_sites).select(*key)
    return about.filter(F.col("about") > min_sites + margin).select(*key).union(exact)


def remove_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                        min_sites: int = MIN_SITES, with_text: bool = False) -> DataFrame:
    """Per row: id, n_lines (not blank), n_removed, kept_sha256; with ``with_text`` also the kept text."""
    stages = Stages(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), F.col(site_col).alias("site"))
    rows = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), F.col("text")))
    each = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.btrim(x, F.lit(SPACES)) != "", F.struct(
        i.alias("at"), _key(x)["h1"].alias("h1"), _key(x)["h2"].alias("h2"))))
    # One narrow pass over the texts: a row a document with the hashes of its lines.
    hashed = stages.write(rows.select("id", "t1", "t2", "site", F.sha2("text", 256).alias("sha"),
                                      F.filter(each, lambda x: x.isNotNull()).alias("lines")), "hashed")
    lines = hashed.select("t1", "t2", "site", F.inline("lines"))
    spread = stages.write(spread_lines(lines, stages, min_sites), "spread")
    hit = lines.join(spread, ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("at").alias("gone"))
    hit = stages.write(hit, "hit")
    # Only texts that lose a line are read again; equal texts once.
    keep = let(F.split("text", "\n"), lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: F.get(ls, i)), "\n"))
    cut = rows.select("t1", "t2", "text").join(hit.hint("merge"), ["t1", "t2"]).groupBy("t1", "t2").agg(
        F.first(F.struct("text", "gone")).alias("x")).select("t1", "t2", "x.*").select(
        "t1", "t2", F.size("gone").cast("long").alias("n_removed"), keep.alias("kept"))
    cut = stages.write(cut.select("t1", "t2", "n_removed", F.sha2("kept", 256).alias("kept_sha"), *(["kept"] if with_text else [])), "cut")
    stages.drop("about", "spread", "hit")
    out = hashed.join(cut, ["t1", "t2"], "left").select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        *(["t1", "t2", "kept"] if with_text else []))
    if not with_text:
        return out
    texts = rows.select("t1", "t2", F.col("text").alias("whole")).dropDuplicates(["t1", "t2"])
    return out.join(texts, ["t1", "t2"]).select(id_col, "n_lines", "n_removed", "kept_sha256", F.coalesce("kept", "whole").alias(text_col))

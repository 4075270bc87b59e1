"""Source embeddings as a table (J6): (kind, idx, vec), row 0 for sources that weren't seen.

The table grows with the sources, so it is data, not a parameter: it is made from the
vocabulary by Spark, looked up by joins, trained row by row (``training``) and written like any
table. Only its two rows 0 (a vector each) come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.params import PARAM_ORDER, ModelParams

KINDS = {"claim": "claim_src", "evidence": "evidence_src"}
#: The model types that use a kind's table.
USED = {"claim": (1, 3), "evidence": (2, 3)}


def kinds(params: ModelParams) -> list[str]:
    """The kinds that the model reads."""
    return [k for k in KINDS if params.model_type in USED[k]]


def width(params: ModelParams, kind: str) -> int:
    return params.claim_src_dim if kind == "claim" else params.evidence_src_dim


def _rows(vocab: DataFrame) -> DataFrame:
    """([run, ]kind, idx, n): every index of the vocabularies and 0, and the number of a kind's rows."""
    run = ["run"] if "run" in vocab.columns else []
    once = vocab.select(*run).distinct() if run else vocab.sparkSession.range(1)
    none = once.select(*run, F.explode(F.array(*map(F.lit, KINDS))).alias("kind"), F.lit(0).alias("idx"))
    rows = vocab.select(*run, "kind", F.col("idx").cast("int").alias("idx")).unionByName(none)
    return rows.join(rows.groupBy(*run, "kind").agg((F.max("idx") + 1).alias("n")), [*run, "kind"])  # two rows a run


def _vectors(rows: DataFrame, params: ModelParams, entry) -> DataFrame:
    """``entry(kind, j)`` for each component."""
    def row(kind: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width(params, kind) - 1)), lambda j: entry(kind, j))

    of = {k: row(k) for k in KINDS}
    return rows.select(*(c for c in rows.columns if c != "n"), F.when(F.col("kind") == "claim", of["claim"]).otherwise(of["evidence"]).alias("vec"))


def formula_tables(vocab: DataFrame, params: ModelParams) -> DataFrame:
    """The fixture's tables, sized by the vocabularies: F_params' closed formula."""
    def entry(kind: str, j: Column) -> Column:
        m = PARAM_ORDER.index(KINDS[kind])
        return F.sin(1.0 + 31.0 * F.col("idx") + 17.0 * j + 101.0 * m) / F.sqrt("n")
    return _vectors(_rows(vocab), params, entry)


def random_tables(vocab: DataFrame, params: ModelParams, seed: int = 42) -> DataFrame:
    """Standard normal entries from hashes of (seed, kind, idx, component): the same on every retry."""
    def uniform(kind: str, j: Column, k: int) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(kind), F.col("idx"), j, F.lit(k))
        return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(2.0 ** 53)

    def entry(kind: str, j: Column) -> Column:
        return F.sqrt(-2.0 * F.log(uniform(kind, j, 0))) * F.cos(2 * math.pi * uniform(kind, j, 1))
    return _vectors(_rows(vocab), params, entry)


def unseen(tables: DataFrame) -> dict[str, np.ndarray]:
    """Row 0 of each kind."""
    return {r.kind: np.array(r.vec, np.float64) for r in tables.filter("idx = 0").select("kind", "vec").collect()}


def by_value(vocab: DataFrame, tables: DataFrame, kind: str) -> DataFrame:
    """(value, idx, vec) of a kind: one join gives a row its source's vector."""
    own = vocab.filter(F.col("kind") == kind).select("value", F.col("idx").cast("int").alias("idx"))
    return own.join(tables.filter(F.col("kind") == kind).select("idx", "vec"), "idx").select("value", "idx", "vec")


def source_vectors(rows: DataFrame, coded: DataFrame, col: str, name: str) -> DataFrame:
    """``rows`` with the vector of their source; null for one that wasn't seen."""
    v = coded.select(F.col("value").alias("_v"), F.col("vec").alias(name))
    return rows.join(v, F.col(col) == F.col("_v"), "left").drop("_v")


def source_indices(rows: DataFrame, vocab: DataFrame, kind: str, col: str, name: str) -> DataFrame:
    """``rows`` with their source's index, 0 for one that wasn't seen."""
    v = vocab.filter(F.col("kind") == kind).select(F.col("value").alias("_v"), F.col("idx").cast("int").alias("_i"))
    return rows.join(v, F.col(col) == F.col("_v"), "left").withColumn(name, F.coalesce("_i", F.lit(0))).drop("_v", "_i")

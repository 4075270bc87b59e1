"""Source vocabularies and lookups.

Index = first appearance in example order, from 1; 0 = unseen. First
appearance is a ``min`` over an order struct (partial aggregate), then one
global-position pass over the distinct values -- no single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.common import maybe_broadcast
from claimlens.operators.order import global_position, group_position

EXAMPLE_ORDER = ["cred_label", "claim_id", "claim", "claim_source"]


def vocab_claim_source(examples: DataFrame) -> DataFrame:
    """A2: (kind='claim', value, idx) in first-appearance order."""
    first = examples.groupBy(F.col("claim_source").alias("value")).agg(
        F.min(F.struct(*EXAMPLE_ORDER)).alias("k"))
    order = [F.col(f"k.{c}") for c in EXAMPLE_ORDER]
    pos = global_position(first, order, name="_p")
    return pos.select(F.lit("claim").alias("kind"), "value", (F.col("_p") + 1).cast("int").alias("idx"))


def vocab_evidence_source(examples: DataFrame) -> DataFrame:
    """A3: (kind='evidence', value, idx); order = (example, position in claim)."""
    ex = examples.select(*EXAMPLE_ORDER, F.posexplode("evidences").alias("evi_pos", "e"))
    first = ex.groupBy(F.col("e.evidence_source").alias("value")).agg(
        F.min(F.struct(*EXAMPLE_ORDER, "evi_pos")).alias("k"))
    order = [F.col(f"k.{c}") for c in [*EXAMPLE_ORDER, "evi_pos"]]
    pos = global_position(first, order, name="_p")
    return pos.select(F.lit("evidence").alias("kind"), "value",
                      (F.col("_p") + 1).cast("int").alias("idx"))


def vocabularies(examples: DataFrame) -> DataFrame:
    """A2 + A3 from one position pass: first appearances of both kinds are
    unioned and numbered per kind (claim sources order by example, evidence
    sources by (example, position))."""
    claim = examples.select(F.lit("claim").alias("kind"), F.col("claim_source").alias("value"),
                            *EXAMPLE_ORDER, F.lit(-1).alias("evi_pos"))
    evid = examples.select(F.lit("evidence").alias("kind"), *EXAMPLE_ORDER,
                           F.posexplode("evidences").alias("evi_pos", "e")) \
        .select("kind", F.col("e.evidence_source").alias("value"), *EXAMPLE_ORDER, "evi_pos")
    first = claim.unionByName(evid).groupBy("kind", "value").agg(
        F.min(F.struct(*EXAMPLE_ORDER, "evi_pos")).alias("k"))
    order = [F.col(f"k.{c}") for c in [*EXAMPLE_ORDER, "evi_pos"]]
    pos = group_position(first, ["kind"], order, name="_p")
    return pos.select("kind", "value", (F.col("_p") + 1).cast("int").alias("idx"))


def vocab_size(vocab: DataFrame) -> DataFrame:
    """A4: number of entries + 1 (index 0 is reserved for unseen) per kind."""
    return vocab.groupBy("kind").agg((F.count(F.lit(1)) + 1).alias("size"))


def encode_claim_source(examples: DataFrame, vocab: DataFrame, col: str = "claim_source",
                        name: str = "claim_src_idx") -> DataFrame:
    """Left lookup, unseen -> 0. The vocabulary is broadcast only when its
    estimated size is under the limit."""
    v = vocab.where(F.col("kind") == "claim").select(F.col("value").alias("_v"),
                                                    F.col("idx").alias("_i"))
    j = examples.join(maybe_broadcast(v), F.col(col) == F.col("_v"), "left")
    return j.withColumn(name, F.coalesce(F.col("_i"), F.lit(0))).drop("_v", "_i")


def encode_evidence_source(examples: DataFrame, vocab: DataFrame, key: str = "claim_id",
                           name: str = "evidence_src_idx") -> DataFrame:
    """Per array element lookup, unseen -> 0, original order kept.

    posexplode -> lookup -> ordered regroup per claim (bounded by its list)."""
    v = vocab.where(F.col("kind") == "evidence").select(F.col("value").alias("_v"),
                                                       F.col("idx").alias("_i"))
    ex = examples.select(key, F.posexplode("evidences").alias("_p", "_e"))
    j = ex.join(maybe_broadcast(v), F.col("_e.evidence_source") == F.col("_v"), "left")
    idx = (j.groupBy(key)
           .agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_i", F.lit(0)).alias("i"))))
                .alias("_l"))
           .select(key, F.transform("_l", lambda s: s["i"]).alias(name)))
    return examples.join(idx, key, "left").withColumn(
        name, F.coalesce(F.col(name), F.array().cast("array<int>")))


def encode_evidence_rows(rows: DataFrame, vocab: DataFrame, col: str = "evidence_source",
                         name: str = "evidence_src_idx") -> DataFrame:
    """J5 in flat form (one row per evidence): plain left lookup."""
    v = vocab.where(F.col("kind") == "evidence").select(F.col("value").alias("_v"),
                                                       F.col("idx").alias("_i"))
    j = rows.join(maybe_broadcast(v), F.col(col) == F.col("_v"), "left")
    return j.withColumn(name, F.coalesce(F.col("_i"), F.lit(0))).drop("_v", "_i")

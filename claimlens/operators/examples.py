"""Claim documents and class statistics.

Downstream operators work on the flat evidence rows keyed by claim; the
nested document (one row per claim) is built where a consumer needs it -- the
JSON sink and the per-claim features. Its size is the claim's evidence list,
which the corpus bounds (search results per claim, ``cap_evidence``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.normalise import label_int, label_string

GROUP_KEYS = ["cred_label", "id_left", "claim_text", "claim_source"]


def clean_claim_rows(rows: DataFrame, null_label: str = "nan") -> DataFrame:
    """Q1/Q2: label to string (null -> 'nan', kept); null group keys dropped."""
    dtype = rows.schema["cred_label"].dataType
    out = rows.withColumn("cred_label", label_string(F.col("cred_label"), dtype, null_label))
    return out.where(F.col("id_left").isNotNull() & F.col("claim_text").isNotNull()
                     & F.col("claim_source").isNotNull())


def dropped_rows(rows: DataFrame) -> DataFrame:
    """How many rows the null-key rule drops (Q1)."""
    bad = F.col("id_left").isNull() | F.col("claim_text").isNull() | F.col("claim_source").isNull()
    return rows.agg(F.count(F.when(bad, 1)).alias("dropped"))


def group_claim_examples(rows: DataFrame, order_col: str = "row_pos",
                         null_label: str = "nan") -> DataFrame:
    """A1: one document per (label, claim id, text, source), evidence in file order.

    Schema: cred_label, claim_id, claim, claim_source,
            evidences ARRAY<STRUCT<evidence, evidence_source, correlation>>.
    """
    clean = clean_claim_rows(rows, null_label)
    if "correlation" not in clean.columns:
        clean = clean.withColumn("correlation", F.lit(-1.0))
    item = F.struct(F.col(order_col).alias("o"), "evidence", "evidence_source", "correlation")
    # The grouping keeps a shuffle of its own: reusing the evidence match's
    # partitioning would forbid AQE to split a hot claim's join.
    g = clean.groupBy(*GROUP_KEYS).agg(F.array_sort(F.collect_list(item)).alias("_ev"))
    ev = F.transform("_ev", lambda e: F.struct(
        e["evidence"].alias("evidence"), e["evidence_source"].alias("evidence_source"),
        e["correlation"].alias("correlation")))
    return g.select("cred_label", F.col("id_left").alias("claim_id"),
                    F.col("claim_text").alias("claim"), "claim_source", ev.alias("evidences"))


def examples_check_view(ex: DataFrame) -> DataFrame:
    """Flat, engine-neutral digest of claim documents for the SQL oracle."""
    micro = F.transform("evidences", lambda e: F.round(e["correlation"] * 1e6).cast("bigint")
                        .cast("string"))
    return ex.select(
        "claim_id", "cred_label", "claim_source",
        F.md5("claim").alias("claim_md5"),
        F.size("evidences").cast("bigint").alias("n_evidence"),
        F.array_join(F.transform("evidences", lambda e: e["evidence_source"]), "|").alias("sources"),
        F.array_join(micro, ",").alias("correlations"),
        F.md5(F.array_join(F.transform("evidences", lambda e: e["evidence"]), "\u0001"))
        .alias("evidence_md5"),
    )


def class_weights(examples: DataFrame, positive: str = "True") -> DataFrame:
    """A5: per class 0/1 the example count and its share; both classes present.
    The per-class counts are two numbers; their total comes back as a scalar."""
    spark = examples.sparkSession
    lab = examples.select(label_int(F.col("cred_label"), positive).alias("label"))
    counts = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = sum(r["n"] for r in counts.collect())
    classes = spark.range(2).select(F.col("id").cast("int").alias("label"))
    out = classes.join(counts, "label", "left").fillna(0, ["n"])
    weight = F.lit(None).cast("double") if total == 0 else F.col("n") / F.lit(float(total))
    return out.select("label", F.col("n").cast("bigint").alias("n"), weight.alias("weight"))


def example_positions(examples: DataFrame, positive: str = "True") -> DataFrame:
    """Examples in group-key order with their index, label and count."""
    from claimlens.operators.order import global_position
    ex = examples.select("cred_label", "claim_id", "claim", "claim_source",
                         label_int(F.col("cred_label"), positive).alias("label"),
                         F.size("evidences").alias("n_evidence"))
    return global_position(ex, ["cred_label", "claim_id", "claim", "claim_source"], name="example_pos")

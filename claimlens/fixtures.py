"""Fixture views over the driver's test tables.

The test tables hold no fact-check corpus, so each view below plays one of the
reference's inputs. Every view is defined twice -- here as DataFrame code and
in ``claimlens.plans.oracle_views`` as DuckDB SQL -- and the two must agree
row for row. All work is derived from the given tables, so it grows with them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.params import ModelParams, fixture_params

# Fixed fixture values: event type -> metric name of the training history.
HISTORY_METRICS = {
    "click": "loss",
    "view": "accuracy",
    "purchase": "auc",
    "signup": "f1_macro",
    "error": "classify_loss",
}

# Model shape used by the scoring fixtures (embedding width is the table's).
FIXTURE_DIMS = dict(emb_dim=64, hidden_dim=8, claim_src_dim=4, evidence_src_dim=4,
                    mlp_hidden=3, top_k=5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_rows: one evidence row per (claim, snippet); turn 0 is the claim."""
    conv = table(spark, sf_dir, "conversations")
    a = conv.where(F.col("turn") == 0).select(
        F.col("conv_id").alias("id_left"), F.col("text").alias("claim_text"))
    b = conv.where(F.col("turn") > 0).select(
        F.col("conv_id").alias("id_left"), "turn",
        F.col("text").alias("evidence"), F.col("role").alias("evidence_source"))
    j = a.join(b, "id_left")
    key = F.col("id_left") * 100 + F.col("turn")
    return j.select(
        "id_left",
        key.alias("id_right"),
        F.when(F.col("id_left") % 3 == 0, "True").otherwise("False").alias("cred_label"),
        "claim_text",
        F.concat(F.lit("site"), (F.col("id_left") % 7).cast("string")).alias("claim_source"),
        "evidence",
        "evidence_source",
        key.alias("row_pos"),
    )


def rank_id():
    """List id of a conversation; ids ending in 9 get an 'x' prefix, so those
    claims have no ranked list (J3, correlation -1) while every row is used."""
    cid = F.col("conv_id").cast("string")
    return F.when(F.col("conv_id") % 10 == 9, F.concat(F.lit("x"), cid)).otherwise(cid)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_ranked: exploded ranked evidence (id, pos, snippet, score)."""
    conv = table(spark, sf_dir, "conversations")
    first = conv.select(
        rank_id().alias("id"),
        F.col("turn").alias("pos"),
        F.concat(
            F.expr("substring(text, 1 + CAST(conv_id % 2 AS INT), 12)"),
            F.when((F.col("conv_id") % 2 == 1) & (F.col("turn") % 2 == 0), "~").otherwise(""),
        ).alias("snippet"),
        (F.lit(1.0) / (F.col("turn") + 1)).alias("score"),
    )
    second = conv.select(
        rank_id().alias("id"),
        (F.col("turn") + 100).alias("pos"),
        F.expr("substring(text, CASE WHEN turn % 3 = 2 THEN 5 ELSE 3 END, 6)").alias("snippet"),
        (F.lit(2.0) / (F.col("turn") + 1)).alias("score"),
    )
    return first.unionByName(second)


def ranked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_ranked in the source's nested shape: one ordered list per id.

    Lists are per conversation (a handful of turns), so the regroup is bounded.
    """
    r = ranked(spark, sf_dir)
    return r.groupBy("id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "snippet", "score"))),
            lambda e: F.struct(e["snippet"].alias("snippet"), e["score"].alias("score")),
        ).alias("evidences"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_scores: repeated logits (ties), binary label, fold."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.round(F.lit(4.0) * e.embedding[0].cast("double"), 2).alias("logit"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"),
        (F.col("vec_id") % 5).cast("int").alias("fold"),
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_pred: hard predictions."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.col("quality").alias("label"),
                      (F.lit(1) - F.col("toxic")).alias("prediction"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_tokens: token vectors of claims (evi_pos -1) and their evidence.

    Every embedding row is used and the claims grow with the rows. claim =
    vec_id div 25; the claim's rows s = vec_id % 25 are dealt round-robin over its 3 + c % 6 texts (the claim
    itself and 2 + c % 6 evidences): text = s mod (3 + c % 6), evi_pos =
    text - 1, tok_pos = s div (3 + c % 6). Claims below and above top-k occur.
    """
    e = table(spark, sf_dir, "embeddings")
    claim = (F.col("vec_id") / 25).cast("bigint")
    texts = F.lit(3) + claim % 6
    s = F.col("vec_id") % 25
    return e.select(
        claim.alias("claim_id"),
        ((s % texts) - 1).cast("int").alias("evi_pos"),
        (s / texts).cast("int").alias("tok_pos"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def token_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim-level side data of the token fixture: sources, label."""
    t = tokens(spark, sf_dir).where(F.col("evi_pos") == -1).select("claim_id").distinct()
    return t.select(
        "claim_id",
        F.concat(F.lit("site"), (F.col("claim_id") % 7).cast("string")).alias("claim_source"),
        F.when(F.col("claim_id") % 3 == 0, 1).otherwise(0).alias("label"),
    )


def evidence_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence-level side data of the token fixture: source, correlation."""
    t = tokens(spark, sf_dir).where(F.col("evi_pos") >= 0).select("claim_id", "evi_pos").distinct()
    return t.select(
        "claim_id", "evi_pos",
        F.concat(F.lit("src"), ((F.col("claim_id") + F.col("evi_pos")) % 5).cast("string"))
        .alias("evidence_source"),
        (((F.col("claim_id") * 7 + F.col("evi_pos") * 3) % 11).cast("double") / 10.0)
        .alias("correlation"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_history: per-fold metric history of unequal length (20..24 epochs), over all events."""
    ev = table(spark, sf_dir, "events")
    epoch = (F.dayofmonth("ts") - 1) % (20 + F.col("user_id") % 5)
    m = F.create_map(*[x for kv in HISTORY_METRICS.items() for x in map(F.lit, kv)])
    split = (F.when((F.col("user_id") / 5).cast("bigint") % 3 == 0, "train")
             .when((F.col("user_id") / 5).cast("bigint") % 3 == 1, "valid")
             .otherwise("test"))
    return (ev.groupBy((F.col("user_id") % 5).cast("int").alias("fold"),
                     epoch.cast("int").alias("epoch"),
                     split.alias("split"),
                     m[F.col("event_type")].alias("metric"))
            .agg(F.avg("value").alias("value")))


def passages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """F_passages: (documents, benchmark) as they are."""
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")


def params_for(spark: SparkSession, sf_dir: str, model_type: int = 3) -> ModelParams:
    """F_params' matrices; its source tables are ``source_tables.formula_tables`` of the vocabularies."""
    return fixture_params(model_type=model_type, **FIXTURE_DIMS)


__all__ = ["rows", "ranked", "ranked_lists", "scores", "pred", "tokens", "token_sources",
           "evidence_meta", "history", "passages", "params_for", "table"]

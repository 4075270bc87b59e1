"""Losses (L1-L3) as grouped aggregates.

List-wise loss per claim: -sum_i softmax(t)_i * log_softmax(s)_i, written as
-(sum_i e^(t_i-mt) s_i / sum_i e^(t_i-mt) - ms - log sum_i e^(s_i-ms)): one
max pass and one sum pass per claim, both partial aggregates, so a claim with
a huge slot list is combined map-side instead of landing in one window task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bce_terms(logit, label):
    """Stable BCE-with-logits term: max(x,0) - x*y + log(1 + exp(-|x|))."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def bce_logits(df: DataFrame, group: list[str], logit: str = "logit", label: str = "label") -> DataFrame:
    """L1: mean BCE from logits per group."""
    return df.groupBy(*group).agg(
        F.avg(bce_terms(F.col(logit), F.col(label).cast("double"))).alias("bce"))


def listnet_per_claim(slots: DataFrame, claim: str = "claim_id", pred: str = "affinity",
                      target: str = "correlation") -> DataFrame:
    """L2 per claim over its slots (padded slots included by the caller)."""
    mx = slots.groupBy(claim).agg(F.max(pred).alias("_ms"), F.max(target).alias("_mt"))
    j = slots.join(mx, claim)
    et = F.exp(F.col(target) - F.col("_mt"))
    agg = j.groupBy(claim).agg(
        F.sum(F.exp(F.col(pred) - F.col("_ms"))).alias("_ss"), F.sum(et).alias("_st"),
        F.sum(et * F.col(pred)).alias("_sts"), F.first("_ms").alias("_ms"))
    loss = -(F.col("_sts") / F.col("_st") - F.col("_ms") - F.log(F.col("_ss")))
    return agg.select(claim, loss.alias("listnet"))


def listnet(slots: DataFrame, claim: str = "claim_id", pred: str = "affinity",
            target: str = "correlation", group: list[str] | None = None) -> DataFrame:
    """L2: mean over claims of the per-claim list-wise loss."""
    group = group or []
    per = listnet_per_claim(slots, claim, pred, target)
    if group:
        keys = slots.select(claim, *group).distinct()
        per = per.join(keys, claim)
    return per.groupBy(*group).agg(F.avg("listnet").alias("listnet"))


def joint_loss(listnet_col, bce_col, alpha: float = 0.01):
    """L3: alpha * ranking loss + classification loss."""
    return F.lit(alpha) * listnet_col + bce_col

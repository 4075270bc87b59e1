"""Projections and predicates over evidence rows.

All are row-local expressions (no shuffle) except ``cap_evidence``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.operators.order import global_position

ALIGNED = ["cred_label", "claim", "claim_source", "evidence", "evidence_source"]

# Label alignment tables of the two corpus layouts.
LABELS_A = {"true": "true", "mostly true": "true", "false": "false", "mostly false": "false"}
LABELS_B = {"True": "true", "Half-True": "true", "Mostly True": "true",
            "False": "false", "Pants on Fire!": "false", "Mostly False": "false"}


def _map_col(c: Column, table: dict) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return m[c]


def align_layout_a(df: DataFrame) -> DataFrame:
    """P2 + P4: 5 positional columns (0, 2, 1, 3, 4) -> aligned names; labels A."""
    cols = df.columns
    out = df.select(*[F.col(cols[i]) for i in (0, 2, 1, 3, 4)]).toDF(*ALIGNED)
    return out.withColumn("cred_label", _map_col(F.col("cred_label"), LABELS_A))


def align_layout_b(df: DataFrame) -> DataFrame:
    """P3 + P5: 6 positional columns (0, 2, 3, 4, 5) -> aligned names; labels B."""
    cols = df.columns
    out = df.select(*[F.col(cols[i]) for i in (0, 2, 3, 4, 5)]).toDF(*ALIGNED)
    return out.withColumn("cred_label", _map_col(F.col("cred_label"), LABELS_B))


def label_map(c: Column, layout: str = "a") -> Column:
    return _map_col(c, LABELS_A if layout == "a" else LABELS_B)


def evidence_rank(df: DataFrame, keys: list[str], evidence: str = "evidence",
                  name: str = "rank") -> DataFrame:
    """Pandas average rank of the evidence text inside ``keys``, truncated.

    average rank = (rows with a smaller text) + (ties + 1) / 2. The smaller-row
    count is a weighted prefix over distinct (keys, text) -- range partitioned,
    so a claim with a huge evidence list never lands in one window task.
    Rows with a null key or text are dropped first (pandas raises there).
    """
    clean = df.where(F.col(evidence).isNotNull())
    for k in keys:
        clean = clean.where(F.col(k).isNotNull())
    distinct = clean.groupBy(*keys, evidence).agg(F.count(F.lit(1)).alias("_n"))
    pref = global_position(distinct, [*keys, evidence], name="_p", weight="_n")
    first = pref.groupBy(*keys).agg(F.min("_p").alias("_p0"))
    ranks = (pref.join(first, keys)
             .select(*keys, evidence,
                     F.floor(F.col("_p") - F.col("_p0") + (F.col("_n") + 1) / 2.0)
                     .cast("int").alias(name)))
    return clean.join(ranks, [*keys, evidence])


def evidence_rank_window(df: DataFrame, keys: list[str], evidence: str = "evidence",
                         name: str = "rank") -> DataFrame:
    """W1 as plain windows (small inputs, tests): rank + tie count."""
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy(evidence)
    wt = W.partitionBy(*keys, evidence)
    avg = F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0
    clean = df.where(F.col(evidence).isNotNull())
    for k in keys:
        clean = clean.where(F.col(k).isNotNull())
    return clean.withColumn(name, F.floor(avg).cast("int"))


def cap_evidence(df: DataFrame, keys: list[str] | None = None, limit: int = 29) -> DataFrame:
    """Keep rows whose average text rank is below ``limit``."""
    keys = keys or ["cred_label", "claim", "claim_source"]
    return evidence_rank(df, keys).where(F.col("rank") < limit).drop("rank")


def align(raw: DataFrame, layout: str, limit: int = 29) -> DataFrame:
    """P2-P6 as one operator: a raw layout's columns and labels aligned, then the cap on the
    evidences of a claim; rows without a label (or another key) go, as in the source."""
    return cap_evidence({"a": align_layout_a, "b": align_layout_b}[layout](raw), limit=limit)


def label_string(c: Column, dtype: T.DataType | None = None, null_label: str = "nan") -> Column:
    """Label to its string form; null -> 'nan'; booleans print True/False."""
    s = F.initcap(c.cast("string")) if isinstance(dtype, T.BooleanType) else c.cast("string")
    return F.coalesce(s, F.lit(null_label))


def label_int(c: Column, positive: str = "True") -> Column:
    """1 only for the exact positive string, else 0 (null -> 0)."""
    return F.coalesce((c == F.lit(positive)).cast("int"), F.lit(0))


def threshold_prob(prob: Column, threshold: float = 0.5) -> Column:
    """Strict ``prob > threshold``."""
    return (prob > F.lit(threshold)).cast("int")


def threshold_logit(logit: Column) -> Column:
    """Strict ``logit > 0``."""
    return (logit > F.lit(0.0)).cast("int")


def outcome(prediction: Column, label: Column) -> Column:
    """TP / FP / TN / FN in one pass."""
    return (F.when((prediction == label) & (prediction == 1), "tp")
            .when((prediction != label) & (prediction == 1), "fp")
            .when((prediction == label) & (prediction == 0), "tn")
            .otherwise("fn"))

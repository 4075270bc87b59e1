"""Evaluation metrics (A6-A12, A15) as one-pass aggregates.

Every metric takes a frame of (group columns..., score/prediction, label) and
returns one row per group: counts are ``count_if`` partial aggregates, so a
hot group is combined map-side. AUC and the ROC curve need an order over the
scores: per (group, score) counts first (distinct scores, partial aggregate),
then a range-partitioned prefix sum (``group_position``), never a window over
all rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.order import group_position


def _zdiv(a: Column, b: Column) -> Column:
    """Zero-safe division: 0 when the denominator is 0 (Q20)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_counts(df: DataFrame, group: list[str], prediction: str = "prediction",
                     label: str = "label") -> DataFrame:
    """tp/fp/fn for class 0 and class 1, one pass."""
    p, y = F.col(prediction), F.col(label)
    c = lambda cond: F.count_if(cond).cast("bigint")
    return df.groupBy(*group).agg(
        c((p == 0) & (p == y)).alias("tp_0"), c((p == 0) & (p != y)).alias("fp_0"),
        c((p != 0) & (p != y)).alias("fn_0"), c((p == 1) & (p == y)).alias("tp_1"),
        c((p == 1) & (p != y)).alias("fp_1"), c((p != 1) & (p != y)).alias("fn_1"),
        F.count(F.lit(1)).alias("n"))


def prf_from_counts(cc: DataFrame) -> DataFrame:
    """A8 + A10 over A6: precision/recall/F1 per class, macro and micro F1."""
    out = cc
    for k in ("0", "1"):
        tp, fp, fn = F.col(f"tp_{k}"), F.col(f"fp_{k}"), F.col(f"fn_{k}")
        out = out.withColumn(f"precision_{k}", _zdiv(tp, tp + fp)) \
                 .withColumn(f"recall_{k}", _zdiv(tp, tp + fn))
        pr, rc = F.col(f"precision_{k}"), F.col(f"recall_{k}")
        out = out.withColumn(f"f1_{k}", _zdiv(2 * pr * rc, pr + rc))
    tp = F.col("tp_0") + F.col("tp_1")
    fp = F.col("fp_0") + F.col("fp_1")
    fn = F.col("fn_0") + F.col("fn_1")
    pm, rm = _zdiv(tp, tp + fp), _zdiv(tp, tp + fn)
    return (out.withColumn("f1_macro", (F.col("f1_0") + F.col("f1_1")) / 2)
            .withColumn("f1_micro", _zdiv(2 * pm * rm, pm + rm)))


def accuracy(df: DataFrame, group: list[str], prediction: str = "prediction",
             label: str = "label") -> DataFrame:
    """A9."""
    return df.groupBy(*group).agg(
        F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, group: list[str] | None = None, prediction: str = "prediction",
                     label: str = "label") -> DataFrame:
    """2x2 matrix as rows (label, pred_0, pred_1); all cells present."""
    group = group or []
    spark = df.sparkSession
    cells = (df.groupBy(*group, label).pivot(prediction, [0, 1]).agg(F.count(F.lit(1)))
             .withColumnRenamed("0", "pred_0").withColumnRenamed("1", "pred_1"))
    ltype = df.schema[label].dataType
    if group:
        keys = df.select(*group).distinct().select(
            *group, F.explode(F.array(F.lit(0), F.lit(1))).cast(ltype).alias(label))
    else:
        keys = spark.range(2).select(F.col("id").cast(ltype).alias(label))
    return (keys.join(cells, [*group, label], "left")
            .select(*group, label, F.coalesce("pred_0", F.lit(0)).cast("bigint").alias("pred_0"),
                    F.coalesce("pred_1", F.lit(0)).cast("bigint").alias("pred_1")))


def score_counts(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Per (group, distinct score): positives and negatives."""
    return df.groupBy(*group, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(label).cast("long"))).alias("neg"))


def roc_auc(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Exact ROC AUC, ties count one half; one-class group -> null.

    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N), with neg_below the
    exclusive prefix of negatives in ascending score order per group.
    """
    sc = score_counts(df, group, score, label)
    pref = group_position(sc, group, [score], name="neg_below", weight="neg")
    agg = pref.groupBy(*group).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_num"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    auc = F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(None).cast("double")) \
        .otherwise(F.col("_num") / (F.col("_p") * F.col("_n")))
    return agg.select(*group, auc.alias("auc"))


def roc_curve(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, descending, plus
    the start point (threshold null, i.e. above every score; 0, 0). Collinear
    points are kept."""
    sc = score_counts(df, group, score, label).withColumn("_neg_s", -F.col(score))
    # both prefix sums (positives, negatives) from one range-partitioned pass
    pre = group_position(sc, group, ["_neg_s"], name=["_tp_before", "_fp_before"], weight=["pos", "neg"])
    tot = sc.groupBy(*group).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = pre.join(tot, group).select(
        *group, F.col(score).cast("double").alias("threshold"),
        (F.col("_fp_before") + F.col("neg")).alias("_fp"),
        (F.col("_tp_before") + F.col("pos")).alias("_tp"), "_P", "_N")
    start = tot.select(*group, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("_fp"),
                       F.lit(0).cast("long").alias("_tp"), "_P", "_N")
    allp = pts.unionByName(start)
    return allp.select(*group, "threshold",
                       F.try_divide(F.col("_fp"), F.col("_N")).alias("fpr"),
                       F.try_divide(F.col("_tp"), F.col("_P")).alias("tpr"))


def logit_histogram(df: DataFrame, value: str = "logit", outcome: str = "outcome",
                    bins: int = 10) -> DataFrame:
    """Equal-width histogram over the global [min, max], per outcome and
    overall ('all'); empty bins are filled with 0."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()  # two scalars
    if lo is None:
        lo = hi = 0.0
    width = float(hi) - float(lo)
    if width == 0:
        b = F.lit(0)
    else:
        b = F.least(F.floor((F.col(value) - F.lit(float(lo))) / F.lit(width) * bins),
                    F.lit(bins - 1)).cast("int")
    binned = df.select(F.col(outcome).alias("outcome"), b.alias("bin"))
    both = binned.unionByName(binned.select(F.lit("all").alias("outcome"), "bin"))
    counts = both.groupBy("outcome", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = both.select("outcome").distinct().select(
        "outcome", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, ["outcome", "bin"], "left")
            .select("outcome", "bin",
                    (F.lit(float(lo)) + F.lit(width) * F.col("bin") / bins).alias("lo"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))

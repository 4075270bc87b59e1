"""Evaluation queries over F_scores / F_pred."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixtures as FX
from claimlens.functions.arrays import sigmoid
from claimlens.operators import metrics as MX
from claimlens.operators.losses import bce_logits
from claimlens.operators.normalise import outcome, threshold_logit, threshold_prob
from claimlens.plans.oracle_views import with_views
from claimlens.plans.registry import r6, register

PRED_CTE = ("sp", """
SELECT vec_id, fold, logit, label, 1 / (1 + exp(-logit)) AS prob,
       CAST(1 / (1 + exp(-logit)) > 0.5 AS INTEGER) AS prediction
FROM f_scores""")


def scored(spark, sf_dir):
    s = FX.scores(spark, sf_dir)
    return s.withColumn("prob", sigmoid(F.col("logit"))) \
            .withColumn("prediction", threshold_prob(F.col("prob")))


def _v(sql):
    return with_views(sql, "f_scores", ctes=[PRED_CTE])


@register("sigmoid", _v("SELECT vec_id, round(prob, 6) AS prob FROM sp"))
def q_sigmoid(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", r6("prob").alias("prob"))


@register("threshold_prob", _v("SELECT vec_id, prediction FROM sp"))
def q_threshold_prob(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "prediction")


@register("threshold_logit", _v("SELECT vec_id, CAST(logit > 0 AS INTEGER) AS prediction FROM sp"))
def q_threshold_logit(spark, sf_dir):
    return FX.scores(spark, sf_dir).select("vec_id", threshold_logit(F.col("logit")).alias("prediction"))


OUTCOME_SQL = """CASE WHEN prediction = label AND prediction = 1 THEN 'tp'
     WHEN prediction <> label AND prediction = 1 THEN 'fp'
     WHEN prediction = label AND prediction = 0 THEN 'tn' ELSE 'fn' END"""


@register("outcome_split", _v(f"SELECT vec_id, {OUTCOME_SQL} AS outcome FROM sp"))
def q_outcome(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("vec_id", outcome(F.col("prediction"), F.col("label")).alias("outcome"))


COUNTS_SQL = """
SELECT fold,
  CAST(count_if(prediction = 0 AND prediction = label) AS BIGINT) AS tp_0,
  CAST(count_if(prediction = 0 AND prediction <> label) AS BIGINT) AS fp_0,
  CAST(count_if(prediction <> 0 AND prediction <> label) AS BIGINT) AS fn_0,
  CAST(count_if(prediction = 1 AND prediction = label) AS BIGINT) AS tp_1,
  CAST(count_if(prediction = 1 AND prediction <> label) AS BIGINT) AS fp_1,
  CAST(count_if(prediction <> 1 AND prediction <> label) AS BIGINT) AS fn_1,
  count(*) AS n
FROM sp GROUP BY fold"""


@register("confusion_counts", _v(COUNTS_SQL))
def q_counts(spark, sf_dir):
    return MX.confusion_counts(scored(spark, sf_dir), ["fold"])


def _zd(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


PRF_SQL = """
SELECT fold, {cols} FROM (
  SELECT *, {f1} FROM (
    SELECT *, {pr} FROM cc))""".format(
    pr=", ".join(f"{_zd(f'tp_{k}', f'tp_{k} + fp_{k}')} AS precision_{k}, "
                 f"{_zd(f'tp_{k}', f'tp_{k} + fn_{k}')} AS recall_{k}" for k in "01"),
    f1=", ".join(f"{_zd(f'2 * precision_{k} * recall_{k}', f'precision_{k} + recall_{k}')} AS f1_{k}"
                 for k in "01"),
    cols=", ".join(f"round({c}, 6) AS {c}" for c in
                   ["precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1"]))


@register("prf_by_class", with_views(PRF_SQL, "f_scores", ctes=[PRED_CTE, ("cc", COUNTS_SQL)]))
def q_prf(spark, sf_dir):
    p = MX.prf_from_counts(MX.confusion_counts(scored(spark, sf_dir), ["fold"]))
    return p.select("fold", *[r6(c).alias(c) for c in
                              ["precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1"]])


F1MM_SQL = """
SELECT fold, round((f1_0 + f1_1) / 2, 6) AS f1_macro,
       round(CASE WHEN pm + rm = 0 THEN 0.0 ELSE 2 * pm * rm / (pm + rm) END, 6) AS f1_micro,
       round(acc, 6) AS accuracy
FROM (SELECT fold, f1_0, f1_1,
             {pm} AS pm, {rm} AS rm, (tp_0 + tp_1) / n AS acc
      FROM prf)""".format(
    pm=_zd("tp_0 + tp_1", "tp_0 + tp_1 + fp_0 + fp_1"),
    rm=_zd("tp_0 + tp_1", "tp_0 + tp_1 + fn_0 + fn_1"))
PRF_RAW = PRF_SQL.replace("SELECT fold, {cols} FROM (", "")


@register("f1_macro_micro", with_views(F1MM_SQL, "f_scores", ctes=[
    PRED_CTE, ("cc", COUNTS_SQL),
    ("prf", "SELECT * FROM (SELECT *, " + ", ".join(
        f"{_zd(f'2 * precision_{k} * recall_{k}', f'precision_{k} + recall_{k}')} AS f1_{k}"
        for k in "01") + " FROM (SELECT *, " + ", ".join(
        f"{_zd(f'tp_{k}', f'tp_{k} + fp_{k}')} AS precision_{k}, "
        f"{_zd(f'tp_{k}', f'tp_{k} + fn_{k}')} AS recall_{k}" for k in "01") + " FROM cc))")]))
def q_f1mm(spark, sf_dir):
    s = scored(spark, sf_dir)
    p = MX.prf_from_counts(MX.confusion_counts(s, ["fold"]))
    acc = MX.accuracy(s, ["fold"])
    return p.join(acc, "fold").select("fold", r6("f1_macro").alias("f1_macro"),
                                      r6("f1_micro").alias("f1_micro"), r6("accuracy").alias("accuracy"))


@register("accuracy", _v("SELECT fold, round(avg(CAST(prediction = label AS DOUBLE)), 6) AS accuracy "
                         "FROM sp GROUP BY fold"))
def q_accuracy(spark, sf_dir):
    return MX.accuracy(scored(spark, sf_dir), ["fold"]).select("fold", r6("accuracy").alias("accuracy"))


@register("confusion_matrix", with_views("""
SELECT k.label, CAST(count_if(p.prediction = 0) AS BIGINT) AS pred_0,
       CAST(count_if(p.prediction = 1) AS BIGINT) AS pred_1
FROM (SELECT range AS label FROM range(2)) k LEFT JOIN f_pred p ON p.label = k.label
GROUP BY k.label""", "f_pred"))
def q_confusion_matrix(spark, sf_dir):
    out = MX.confusion_matrix(FX.pred(spark, sf_dir))
    return out.select(F.col("label").cast("bigint").alias("label"), "pred_0", "pred_1")


AUC_SQL = """
SELECT fold, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL
       ELSE round(sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) END AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT fold, {score} AS score, sum(label) AS pos, count(*) - sum(label) AS neg
            FROM {src} GROUP BY fold, {score}))
GROUP BY fold"""


@register("roc_auc", _v(AUC_SQL.format(score="prob", src="sp")))
def q_auc(spark, sf_dir):
    a = MX.roc_auc(scored(spark, sf_dir), ["fold"], score="prob")
    return a.select("fold", r6("auc").alias("auc"))


@register("roc_auc_hard", _v(AUC_SQL.format(score="prediction", src="sp")))
def q_auc_hard(spark, sf_dir):
    """Q19: the test report feeds hard 0/1 predictions into AUC."""
    a = MX.roc_auc(scored(spark, sf_dir), ["fold"], score="prediction")
    return a.select("fold", r6("auc").alias("auc"))


@register("roc_curve", _v("""
SELECT fold, threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM (
  SELECT fold, CAST(score AS DOUBLE) AS threshold,
         sum(neg) OVER (PARTITION BY fold ORDER BY score DESC) AS fp,
         sum(pos) OVER (PARTITION BY fold ORDER BY score DESC) AS tp,
         sum(neg) OVER (PARTITION BY fold) AS n_neg, sum(pos) OVER (PARTITION BY fold) AS n_pos
  FROM (SELECT fold, logit AS score, sum(label) AS pos, count(*) - sum(label) AS neg
        FROM sp GROUP BY fold, logit)
  UNION ALL
  SELECT fold, NULL, 0, 0, count(*) - sum(label), sum(label) FROM sp GROUP BY fold)"""))
def q_roc_curve(spark, sf_dir):
    c = MX.roc_curve(scored(spark, sf_dir), ["fold"], score="logit")
    return c.select("fold", "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("logit_histogram", _v(f"""
WITH o AS (SELECT logit, {OUTCOME_SQL} AS outcome FROM sp),
mm AS (SELECT min(logit) AS lo, max(logit) AS hi FROM sp),
b AS (SELECT outcome, CAST(CASE WHEN hi = lo THEN 0
             ELSE least(floor((logit - lo) / (hi - lo) * 10), 9) END AS INTEGER) AS bin FROM o, mm),
bb AS (SELECT * FROM b UNION ALL SELECT 'all', bin FROM b),
g AS (SELECT outcome, CAST(unnest(range(10)) AS INTEGER) AS bin FROM (SELECT DISTINCT outcome FROM bb))
SELECT g.outcome, g.bin, round(mm.lo + (mm.hi - mm.lo) * g.bin / 10, 6) AS lo,
       CAST(count(bb.bin) AS BIGINT) AS n
FROM g CROSS JOIN mm LEFT JOIN bb ON bb.outcome = g.outcome AND bb.bin = g.bin
GROUP BY g.outcome, g.bin, mm.lo, mm.hi""".replace("WITH o AS", "SELECT * FROM (WITH o AS") + ")"))
def q_hist(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("outcome", outcome(F.col("prediction"), F.col("label")))
    h = MX.logit_histogram(s, "logit", "outcome", bins=10)
    return h.select("outcome", "bin", r6("lo").alias("lo"), "n")


@register("bce_logits", _v("""
SELECT fold, round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS bce
FROM sp GROUP BY fold"""))
def q_bce(spark, sf_dir):
    s = FX.scores(spark, sf_dir)
    return bce_logits(s, ["fold"], "logit", "label").select("fold", r6("bce").alias("bce"))

"""Training and cross-validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixtures as FX
from claimlens.operators import history as HS
from claimlens.operators import training as TR
from claimlens.operators.crossval import cross_validate
from claimlens.operators.scoring import evidence_slots, score_claims
from claimlens.operators.source_tables import source_indices
from claimlens.plans import scoring_sql as SS
from claimlens.plans.oracle_views import with_views
from claimlens.plans.registry import r6, register, scratch
from claimlens.plans.scoring import LISTNET_CTE, LISTNET_SQL, model, scored
from claimlens.session import cut_lineage


def split_col():
    """A split by a seeded hash of the claim id, independent of the label."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("split:8:"), F.col("claim_id").cast("string"))), 1, 8), 16, 10).cast("long") % 3
    return F.when(h == 0, "train").when(h == 1, "valid").otherwise("test")


SPLIT_SQL = ("CASE ('0x' || substr(md5('split:8:' || CAST(claim_id AS VARCHAR)), 1, 8))::BIGINT % 3 "
             "WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END")


def features(spark, sf_dir):
    """(features of all claims with their split, parameters, source tables)"""
    p, vocab, tables = model(spark, sf_dir)
    claims = FX.token_sources(spark, sf_dir)
    res = score_claims(FX.tokens(spark, sf_dir), claims, FX.evidence_meta(spark, sf_dir), p, vocab, tables)
    cl = source_indices(claims, vocab, "claim", "claim_source", "claim_src_idx")
    feats = TR.claim_features(res["slots"], cl.select("claim_id", "label", "claim_src_idx"))
    return feats.withColumn("split", split_col()), p, tables


EPOCH_CTES = [
    LISTNET_CTE, ("ln_claims", LISTNET_SQL),
    ("em", f"""SELECT {SPLIT_SQL} AS split, claim_id, s.label, 1 / (1 + exp(-g.logit)) AS prob,
                      CAST(1 / (1 + exp(-g.logit)) > 0.5 AS INTEGER) AS p,
                      greatest(g.logit, 0) - g.logit * s.label + ln(1 + exp(-abs(g.logit))) AS bce, l.listnet
               FROM logits g JOIN ln_claims l USING (claim_id) JOIN f_token_sources s USING (claim_id)"""),
    ("cells", """SELECT split, k, CAST(count_if(p = k AND label = k) AS DOUBLE) AS tp, count_if(p = k) AS said,
                        count_if(label = k) AS truly FROM em, (SELECT unnest([0, 1]) AS k) GROUP BY split, k"""),
    ("prf", """SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM (
                 SELECT split, k, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS pr,
                        CASE WHEN truly > 0 THEN tp / truly ELSE 0 END AS re FROM cells)"""),
    ("aucs", """SELECT a.split, avg(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END) AS auc
                FROM em a JOIN em b ON a.split = b.split AND a.label = 1 AND b.label = 0 GROUP BY a.split"""),
]
EPOCH_METRICS = ["classify_loss", "listnet", "loss", "rank_loss", "accuracy", "auc", "f1_macro", "f1_micro",
                 *(f"{m}_{k}" for m in ("precision", "recall", "f1") for k in (0, 1))]
_AT = ", ".join(f"round(max({c}) FILTER (k = {k}), 6) AS {m}_{k}" for m, c in (("precision", "pr"), ("recall", "re"), ("f1", "f1"))
                for k in (0, 1))


@register("epoch_metrics", with_views(f"""
SELECT * FROM (
  SELECT split, count(*) AS n, round(avg(bce), 6) AS classify_loss, round(avg(listnet), 6) AS listnet,
         round(avg(bce) + 0.01 * avg(listnet), 6) AS loss, round(0.01 * avg(listnet), 6) AS rank_loss,
         round(avg(CAST(p = label AS DOUBLE)), 6) AS accuracy, round(avg(CAST(p = label AS DOUBLE)), 6) AS f1_micro
  FROM em GROUP BY split)
JOIN (SELECT split, round(avg(f1), 6) AS f1_macro, {_AT} FROM prf GROUP BY split) USING (split)
LEFT JOIN (SELECT split, round(auc, 6) AS auc FROM aucs) USING (split)""",
                                      "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta", params=SS.PARAMS,
                                      ctes=SS.CHAIN + EPOCH_CTES))
def q_epoch_metrics(spark, sf_dir):
    """T5: the whole metric set of each split; the scores are computed once."""
    feats, p, tables = features(spark, sf_dir)
    sc = cut_lineage(TR.head_scores(feats, p, tables, keep=["split"]))
    return TR.epoch_metrics(sc, "split").select("split", "n", *[r6(c).alias(c) for c in EPOCH_METRICS])


LR, DECAY, ALPHA = 1.5e-2, 1e-3, 0.01
_H, _CSD, _K = SS.H, SS.CSD, SS.K


def _forward(s: str, p: str) -> list[tuple[str, str]]:
    """The head's forward pass over the train claims' slots under the parameters ``p``."""
    return [
        (f"aff{s}", f"""SELECT claim_id, evi_pos, bool_or(pad) AS pad, CASE WHEN bool_or(pad) THEN -1.0
                          ELSE tanh(sum(c * w1.v + e * w2.v + c * e * w3.v)) END AS a
                        FROM tr_slots JOIN {p} w1 ON w1.name = 'affinity_w' AND w1.i = tr_slots.j
                        JOIN {p} w2 ON w2.name = 'affinity_w' AND w2.i = tr_slots.j + {_H}
                        JOIN {p} w3 ON w3.name = 'affinity_w' AND w3.i = tr_slots.j + {2 * _H} GROUP BY claim_id, evi_pos"""),
        (f"top{s}", f"""SELECT claim_id, evi_pos, exp(a) / sum(exp(a)) OVER (PARTITION BY claim_id) AS w FROM (
                          SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY a DESC, evi_pos) AS r FROM aff{s}) WHERE r <= {_K}"""),
        # every component of a slot's features: what weighs into the document vector
        (f"feat{s}", f"""SELECT claim_id, evi_pos, w, j AS fi, c AS x FROM top{s} JOIN tr_slots USING (claim_id, evi_pos)
                         UNION ALL SELECT t.claim_id, t.evi_pos, t.w, {_H} + q.j, q.v FROM top{s} t JOIN tr_claims c USING (claim_id)
                         JOIN {p} q ON q.name = 'claim_src' AND q.i = c.cidx
                         UNION ALL SELECT claim_id, evi_pos, w, {_H + _CSD} + j, e FROM top{s} JOIN tr_slots USING (claim_id, evi_pos)
                         UNION ALL SELECT t.claim_id, t.evi_pos, t.w, {2 * _H + _CSD} + q.j, q.v FROM top{s} t
                         JOIN tr_meta m USING (claim_id, evi_pos) JOIN {p} q ON q.name = 'evidence_src' AND q.i = m.sidx"""),
        (f"doc{s}", f"SELECT claim_id, fi, sum(w * x) AS v FROM feat{s} GROUP BY claim_id, fi"),
        (f"hid{s}", f"""SELECT h.claim_id, h.m, h.s + b.v AS v FROM (
                          SELECT d.claim_id, w.j AS m, sum(d.v * w.v) AS s FROM doc{s} d JOIN {p} w ON w.name = 'fc1_w' AND w.i = d.fi
                          GROUP BY d.claim_id, w.j) h JOIN {p} b ON b.name = 'fc1_b' AND b.j = h.m"""),
        (f"z{s}", f"""SELECT h.claim_id, sum(h.v * w.v) + any_value(b.v) AS z FROM hid{s} h JOIN {p} w ON w.name = 'fc3_w' AND w.i = h.m
                      JOIN {p} b ON b.name = 'fc3_b' GROUP BY h.claim_id"""),
        (f"dist{s}", f"""SELECT claim_id, evi_pos, pad, a, exp(a) / sum(exp(a)) OVER (PARTITION BY claim_id) AS sm,
                                exp(t) / sum(exp(t)) OVER (PARTITION BY claim_id) AS st FROM aff{s} JOIN tr_meta USING (claim_id, evi_pos)"""),
        (f"loss{s}", f"""SELECT avg(bce) AS bce, avg(rank) AS rank FROM (
                           SELECT z.claim_id, greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) AS bce, rank FROM z{s} z JOIN tr_claims USING (claim_id)
                           JOIN (SELECT claim_id, -sum(st * ln(sm)) AS rank FROM dist{s} GROUP BY claim_id) USING (claim_id))"""),
    ]


TRAIN_CTES = [
    ("tr_slots", f"""SELECT c.claim_id, c.evi_pos, c.j, c.v AS c, e.v AS e, c.evi_pos >= n AS pad
                     FROM chat c JOIN ehat_all e USING (claim_id, evi_pos, j) JOIN n_ev USING (claim_id) WHERE {SPLIT_SQL} = 'train'"""),
    ("tr_meta", """SELECT s.claim_id, s.evi_pos, coalesce(m.correlation, -1.0) AS t, coalesce(v.idx, 0) AS sidx
                   FROM (SELECT DISTINCT claim_id, evi_pos FROM tr_slots) s LEFT JOIN f_evidence_meta m USING (claim_id, evi_pos)
                   LEFT JOIN vocab_e v ON v.value = m.evidence_source"""),
    ("tr_claims", """SELECT claim_id, CAST(label AS DOUBLE) AS y, idx AS cidx, count(*) OVER () AS n FROM f_token_sources JOIN cidx USING (claim_id)
                     WHERE claim_id IN (SELECT claim_id FROM tr_slots)"""),
    *_forward("0", "f_params"),
    ("gz", "SELECT claim_id, (1 / (1 + exp(-z)) - y) / n AS g, n FROM z0 JOIN tr_claims USING (claim_id)"),
    ("dhid", "SELECT claim_id, w.i AS m, g * w.v AS g FROM gz JOIN f_params w ON w.name = 'fc3_w'"),
    ("ddoc", "SELECT claim_id, w.i AS fi, sum(w.v * d.g) AS g FROM dhid d JOIN f_params w ON w.name = 'fc1_w' AND w.j = d.m GROUP BY claim_id, w.i"),
    ("dwt", "SELECT claim_id, evi_pos, any_value(w) AS w, sum(x * g) AS g FROM feat0 JOIN ddoc USING (claim_id, fi) GROUP BY claim_id, evi_pos"),
    ("dtop", "SELECT claim_id, evi_pos, w * (g - sum(w * g) OVER (PARTITION BY claim_id)) AS g FROM dwt"),
    ("dpre", f"""SELECT d.claim_id, d.evi_pos, (coalesce(t.g, 0) + {ALPHA} / n * (sm - st)) * (1 - a * a) AS g
                 FROM dist0 d JOIN tr_claims USING (claim_id) LEFT JOIN dtop t USING (claim_id, evi_pos) WHERE NOT pad"""),
    ("grads", f"""SELECT 'fc3_w' AS name, m AS i, 0 AS j, sum(v * g) AS g FROM hid0 JOIN gz USING (claim_id) GROUP BY m
                  UNION ALL SELECT 'fc3_b', 0, 0, sum(g) FROM gz
                  UNION ALL SELECT 'fc1_w', fi, m, sum(v * g) FROM doc0 JOIN dhid USING (claim_id) GROUP BY fi, m
                  UNION ALL SELECT 'fc1_b', 0, m, sum(g) FROM dhid GROUP BY m
                  UNION ALL SELECT 'affinity_w', k * {_H} + j, 0, sum(g * CASE k WHEN 0 THEN c WHEN 1 THEN e ELSE c * e END)
                    FROM dpre JOIN tr_slots USING (claim_id, evi_pos), range(3) r(k) GROUP BY k, j
                  UNION ALL SELECT 'claim_src', cidx, fi - {_H}, sum(g) FROM ddoc JOIN tr_claims USING (claim_id)
                    WHERE fi BETWEEN {_H} AND {_H + _CSD - 1} GROUP BY cidx, fi
                  UNION ALL SELECT 'evidence_src', sidx, fi - {2 * _H + _CSD}, sum(w * g) FROM top0 JOIN tr_meta USING (claim_id, evi_pos)
                    JOIN ddoc USING (claim_id) WHERE fi >= {2 * _H + _CSD} GROUP BY sidx, fi"""),
    # Adam's first step: both corrected moments are the gradient's (with the decay)
    ("params1", f"""SELECT name, i, j, v - {LR} * g / (abs(g) + 1e-8) AS v FROM (
                      SELECT p.name, p.i, p.j, p.v, coalesce(g.g, 0) + CASE WHEN p.name IN ('fc1_b', 'fc3_b') THEN 0 ELSE {DECAY} * p.v END AS g
                      FROM f_params p LEFT JOIN grads g ON g.name = p.name AND g.i = p.i AND g.j = p.j
                      WHERE p.name IN ('affinity_w', 'claim_src', 'evidence_src', 'fc1_w', 'fc1_b', 'fc3_w', 'fc3_b'))"""),
    *_forward("1", "params1"),
]


@register("train_head", with_views("""
SELECT CAST(epoch AS INTEGER) AS epoch, 0.01 * rank + bce AS loss, bce AS classify_loss, 0.01 * rank AS rank_loss
FROM (SELECT 0 AS epoch, * FROM loss0 UNION ALL SELECT 1, * FROM loss1)""",
                                   "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta", params=SS.PARAMS,
                                   ctes=SS.CHAIN + TRAIN_CTES))
def q_train(spark, sf_dir):
    """Two epochs of Adam on the train split; per-epoch losses. The second is that of the
    parameters after a step, whose gradients the SQL works out, too."""
    feats, p, tables = features(spark, sf_dir)
    _, _, hist = TR.train_head(feats.where(F.col("split") == "train"), p, tables, epochs=2, lr=LR, weight_decay=DECAY, alpha=ALPHA)
    return spark.createDataFrame([(int(h["epoch"]), float(h["loss"]), float(h["classify_loss"]),
                                   float(h["rank_loss"])) for h in hist],
                                 "epoch int, loss double, classify_loss double, rank_loss double")


@register("train_lr_head")
def q_train_lr(spark, sf_dir):
    """Logistic-regression baseline on the document vectors, class-weighted."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    data = cut_lineage(scored(spark, sf_dir)["head"].join(FX.token_sources(spark, sf_dir), "claim_id").select(
        "claim_id", array_to_vector("doc").alias("features"), F.col("label").cast("double").alias("label")))  # read by every iteration
    share = data.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    total = data.count()
    data = cut_lineage(data.join(share, "label").withColumn("w", F.lit(float(total)) / (2.0 * F.col("c"))))
    model = LogisticRegression(regParam=0.01, weightCol="w").fit(data)
    return model.transform(data).select("claim_id", "label", F.col("prediction").cast("int").alias("prediction"))


def fold_claims(spark, sf_dir):
    return FX.token_sources(spark, sf_dir).withColumn("split", split_col()).withColumn("fold", (F.col("claim_id") % 5).cast("int"))


@register("cross_validate")
def q_cv(spark, sf_dir):
    """T4: k folds with a common valid split; vocabulary, parameters and stop rules per fold;
    per-epoch records for train/valid/test, then the fold average (A13)."""
    p = FX.params_for(spark, sf_dir, 3)
    evidence = FX.evidence_meta(spark, sf_dir)
    slots = evidence_slots(FX.tokens(spark, sf_dir), p) \
        .join(evidence.select("claim_id", "evi_pos", "correlation"), ["claim_id", "evi_pos"], "left") \
        .withColumn("correlation", F.coalesce("correlation", F.lit(-1.0)))
    hist = cross_validate(slots, fold_claims(spark, sf_dir), evidence, p, folds=5, epochs=2, lr=1.5e-2,
                          save_dir=scratch(spark, "cv"))
    avg = HS.fold_average(hist)
    return avg.select("metric", "split", "epoch", r6("value").alias("value"), "n_folds")

"""Vector, attention and scoring queries on F_tokens (F9-F12, A16, A17, W2-W5,
M1-M3, M5-M8, M10, M11, L2, L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens import fixtures as FX
from claimlens.functions import arrays as AR
from claimlens.operators import attention as AT
from claimlens.operators import metrics as MX
from claimlens.operators.losses import bce_terms, joint_loss, listnet_per_claim
from claimlens.operators.params import formula_matrix
from claimlens.operators.scoring import evidence_slots, score_claims, source_vocab
from claimlens.operators.source_tables import formula_tables
from claimlens.plans import scoring_sql as SS
from claimlens.plans.oracle_views import with_views
from claimlens.plans.registry import r6, register, scratch
from claimlens.plans.scoring_sql import H, chain_sql
from claimlens.session import cut_lineage
from claimlens.sources import files as IO


def params(spark, sf_dir):
    return FX.params_for(spark, sf_dir, 3)


def model(spark, sf_dir):
    """(parameters, vocabularies, source tables); the tables are stored and read back, as a model's are, so Spark knows their sizes."""
    p, path = params(spark, sf_dir), scratch(spark, "model")
    IO.write_vocab(source_vocab(FX.token_sources(spark, sf_dir), FX.evidence_meta(spark, sf_dir)), path + "/vocab")
    vocab = IO.read_vocab(spark, path + "/vocab")
    formula_tables(vocab, p).write.parquet(path + "/tables")
    return p, vocab, spark.read.parquet(path + "/tables")


def scored(spark, sf_dir):
    return score_claims(FX.tokens(spark, sf_dir), FX.token_sources(spark, sf_dir), FX.evidence_meta(spark, sf_dir), *model(spark, sf_dir))


def _long(df, keys, col, idx="j", val="v"):
    return df.select(*keys, F.posexplode(col).alias(idx, "_x")).select(*keys, idx, r6("_x").alias(val))


def micros(c):
    """Every component of an array, in millionths, as one string (engine-neutral)."""
    return F.array_join(F.transform(c, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",")


# ------------------------------------------------------------------ F9 / F10
@register("array_softmax", """
SELECT vec_id, array_to_string(list_transform(sm, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',') AS p,
       array_to_string(list_transform(lsm, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',') AS logp
FROM (SELECT vec_id,
        list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) AS sm,
        list_transform(e, lambda x: x - list_max(e) - ln(list_sum(list_transform(e, lambda y: exp(y - list_max(e)))))) AS lsm
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def q_array_softmax(spark, sf_dir):
    e = FX.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    sm, lsm = AR.softmax(F.col("e")), AR.log_softmax(F.col("e"))
    return e.select("vec_id", micros(sm).alias("p"), micros(lsm).alias("logp"))


@register("vector_ops", """
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS sq_norm,
       round(list_sum(list_transform(list_zip(e, list_transform(e, lambda x: tanh(x))), lambda p: p[1] * p[2])), 6) AS dot_tanh,
       CAST(len(list_concat(e, e)) AS INTEGER) AS concat_len,
       round(list_extract(list_transform(list_zip(e, e), lambda p: p[1] * p[2]), 2), 6) AS had1
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def q_vector_ops(spark, sf_dir):
    e = FX.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v = F.col("e")
    return e.select("vec_id", r6(AR.dot(v, v)).alias("sq_norm"), r6(AR.dot(v, AR.vtanh(v))).alias("dot_tanh"),
                    F.size(F.concat(v, v)).alias("concat_len"), r6(F.get(AR.hadamard(v, v), 1)).alias("had1"))


# ------------------------------------------------------------------ F11 / F12 / A16 / A17 / W3
@register("layer_norm", chain_sql(
    "SELECT claim_id, evi_pos, tok_pos, dim, round(z, 6) AS z FROM z", "z"))
def q_layer_norm(spark, sf_dir):
    z = AT.layer_norm_rows(FX.tokens(spark, sf_dir), params(spark, sf_dir))
    return _long(z, ["claim_id", "evi_pos", "tok_pos"], "z", "dim", "z")


@register("linear", chain_sql(
    "SELECT claim_id, evi_pos, tok_pos, j, round(h, 6) AS h FROM hh", "hh"))
def q_linear(spark, sf_dir):
    h = AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir))
    return _long(h, ["claim_id", "evi_pos", "tok_pos"], "h", "j", "h")


@register("layer_norm_expr", chain_sql(
    "SELECT claim_id, evi_pos, tok_pos, dim, round(z, 6) AS z FROM z", "z"))
def q_layer_norm_expr(spark, sf_dir):
    """F11 as a JVM-side higher-order expression (same numbers as the NumPy kernel)."""
    p = params(spark, sf_dir)
    t = FX.tokens(spark, sf_dir)
    g = F.array(*[F.lit(float(x)) for x in p["ln_gain"][0]])
    b = F.array(*[F.lit(float(x)) for x in p["ln_bias"][0]])
    z = t.select("claim_id", "evi_pos", "tok_pos", AR.layer_norm(F.col("vec"), g, b, p.eps).alias("z"))
    return _long(z, ["claim_id", "evi_pos", "tok_pos"], "z", "dim", "z")


@register("mean_pool", chain_sql("""
SELECT claim_id, -1 AS evi_pos, j, round(v, 6) AS v FROM cbar
UNION ALL SELECT claim_id, evi_pos, j, round(v, 6) FROM gbar""", "gbar"))
def q_mean_pool(spark, sf_dir):
    h = AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir))
    m = AT.mean_pool(h, ["claim_id", "evi_pos"], "h", "m")
    return _long(m, ["claim_id", "evi_pos"], "m")


@register("masked_softmax", chain_sql(
    "SELECT claim_id, evi_pos, tok_pos, round(alpha, 6) AS weight FROM ewn", "ewn"))
def q_masked_softmax(spark, sf_dir):
    co = AT.co_attention(AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir)),
                         params(spark, sf_dir), keep_maps=True)
    return co["evidence_map"].select("claim_id", "evi_pos", "tok_pos", r6("weight").alias("weight"))


@register("weighted_pool", chain_sql(
    "SELECT claim_id, evi_pos, j, round(v, 6) AS v FROM ehat", "ehat"))
def q_weighted_pool(spark, sf_dir):
    co = AT.co_attention(AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir)),
                         params(spark, sf_dir))
    return _long(co["slots"], ["claim_id", "evi_pos"], "e_hat")


# ------------------------------------------------------------------ M1 / M3 / W2 / W4 / M6 / M8
@register("co_attention", chain_sql("""
SELECT c.claim_id, c.evi_pos, c.j, round(c.v, 6) AS c_hat, round(e.v, 6) AS e_hat
FROM chat c JOIN ehat e USING (claim_id, evi_pos, j)""", "chat"))
def q_co_attention(spark, sf_dir):
    co = AT.co_attention(AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir)),
                         params(spark, sf_dir))
    s = co["slots"].select("claim_id", "evi_pos",
                           F.posexplode(F.arrays_zip("c_hat", "e_hat")).alias("j", "z"))
    return s.select("claim_id", "evi_pos", "j", r6("z.c_hat").alias("c_hat"), r6("z.e_hat").alias("e_hat"))


@register("affinity", chain_sql(
    "SELECT claim_id, evi_pos, round(affinity, 6) AS affinity FROM aff", "aff"))
def q_affinity(spark, sf_dir):
    s = evidence_slots(FX.tokens(spark, sf_dir), params(spark, sf_dir))
    return s.select("claim_id", "evi_pos", r6("affinity").alias("affinity"))


@register("topk_evidence", chain_sql(
    "SELECT claim_id, evi_pos, CAST(rank AS INTEGER) AS rank FROM topk", "topk"))
def q_topk(spark, sf_dir):
    s = evidence_slots(FX.tokens(spark, sf_dir), params(spark, sf_dir))
    return AT.topk_rows(s, "claim_id", "affinity", "evi_pos", 5).select("claim_id", "evi_pos", "rank")


@register("document_weights", chain_sql(
    "SELECT claim_id, evi_pos, CAST(rank AS INTEGER) AS rank, round(weight, 6) AS weight FROM dw", "dw"))
def q_doc_weights(spark, sf_dir):
    r = scored(spark, sf_dir)["evi_scores"]
    return r.select("claim_id", "evi_pos", "rank", r6("weight").alias("weight"))


@register("document_vector", chain_sql(
    "SELECT claim_id, CAST(fi AS INTEGER) AS j, round(v, 6) AS v FROM docv", "docv"))
def q_doc_vector(spark, sf_dir):
    return _long(scored(spark, sf_dir)["head"], ["claim_id"], "doc")


@register("score_claims", chain_sql("""
SELECT claim_id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS prob,
       CAST(logit > 0 AS INTEGER) AS prediction FROM logits""", "logits"))
def q_score(spark, sf_dir):
    s = scored(spark, sf_dir)["scores"]
    return s.select("claim_id", r6("logit").alias("logit"), r6("prob").alias("prob"), "prediction")


# ------------------------------------------------------------------ W5
@register("attention_levels", chain_sql("""
SELECT claim_id, evi_pos, tok_pos,
       CAST(floor(CASE WHEN hi = lo THEN 0.0 ELSE (alpha - lo) / (hi - lo) * 0.99 END * 6) AS INTEGER) AS level
FROM (SELECT *, min(alpha) OVER (PARTITION BY claim_id, evi_pos) AS lo,
             max(alpha) OVER (PARTITION BY claim_id, evi_pos) AS hi FROM ewn)""", "ewn"))
def q_levels(spark, sf_dir):
    co = AT.co_attention(AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir)),
                         params(spark, sf_dir), keep_maps=True)
    lv = AT.attention_levels(co["evidence_map"], ["claim_id", "evi_pos"], "weight", 6)
    return lv.select("claim_id", "evi_pos", "tok_pos", "level")


HEADS = 2


def _heads_sql():
    mats = " UNION ALL ".join(_extra_sql(m, r, c, n) for m, r, c, n in (
        (23, 2 * H, H, "w1"), (24, H, HEADS, "v1"), (25, 2 * H, H, "w2"), (26, H, HEADS, "v2")))

    def side(name, w, v, tokens):  # tokens: claim_id, evi_pos, tok_pos, j, x (own), y (context)
        return f"""
SELECT claim_id, evi_pos, '{name}' AS side, k * {H} + j AS j, round(sum(wt * x) / sum(wt), 6) AS v FROM (
  SELECT t.claim_id, t.evi_pos, t.j, t.x, s.k, exp(s.sc) AS wt FROM ({tokens}) t JOIN (
    SELECT claim_id, evi_pos, tok_pos, vv.j AS k, sum(tanh(z) * vv.v) AS sc FROM (
      SELECT t.claim_id, t.evi_pos, t.tok_pos, a.j AS o, sum(t.x * a.v + t.y * b.v) AS z
      FROM ({tokens}) t JOIN hp a ON a.name = '{w}' AND a.i = t.j JOIN hp b ON b.name = '{w}' AND b.i = t.j + {H} AND b.j = a.j
      GROUP BY t.claim_id, t.evi_pos, t.tok_pos, a.j) z JOIN hp vv ON vv.name = '{v}' AND vv.i = z.o
    GROUP BY claim_id, evi_pos, tok_pos, vv.j) s USING (claim_id, evi_pos, tok_pos))
GROUP BY claim_id, evi_pos, k, j"""

    evi = "SELECT h.claim_id, h.evi_pos, h.tok_pos, h.j, h.h AS x, c.v AS y FROM hh h JOIN cbar c USING (claim_id, j) WHERE h.evi_pos >= 0"
    cla = "SELECT g.claim_id, g.evi_pos, h.tok_pos, h.j, h.h AS x, g.v AS y FROM gbar g JOIN hh h USING (claim_id, j) WHERE h.evi_pos < 0"
    return with_views(side("evidence", "w1", "v1", evi) + "\nUNION ALL\n" + side("claim", "w2", "v2", cla),
                      "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta", params=SS.PARAMS,
                      ctes=SS.CHAIN[: SS.ORDER.index("gbar") + 1] + [("hp", mats)])


def _extra(m, rows, cols):
    return formula_matrix(m, rows, cols)


def _extra_sql(m, rows, cols, name):
    return (f"SELECT '{name}' AS name, CAST(r.i AS INTEGER) AS i, CAST(c.j AS INTEGER) AS j, "
            f"sin(1 + 31 * r.i + 17 * c.j + {101 * m}) / sqrt({rows}) AS v "
            f"FROM range(0, {rows}) r(i), range(0, {cols}) c(j)")


@register("co_attention_heads", _heads_sql())
def q_co_heads(spark, sf_dir):
    """M1 with two heads: both sides' pooled vectors, all components."""
    h = AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir))
    co = AT.co_attention_heads(h, _extra(23, 2 * H, H), _extra(24, H, HEADS), _extra(25, 2 * H, H), _extra(26, H, HEADS))
    both = co.select("claim_id", "evi_pos", F.explode(F.array(
        F.struct(F.lit("claim").alias("side"), F.col("c_hat").alias("v")),
        F.struct(F.lit("evidence").alias("side"), F.col("e_hat").alias("v")))).alias("s")).select("claim_id", "evi_pos", "s.*")
    return _long(both, ["claim_id", "evi_pos", "side"], "v", "j", "v")


# ------------------------------------------------------------------ L2 / L3 / M11
LISTNET_CTE = ("ln_slots", """
SELECT a.claim_id, a.affinity AS s, coalesce(m.correlation, -1.0) AS t
FROM aff a LEFT JOIN f_evidence_meta m USING (claim_id, evi_pos)""")
LISTNET_SQL = """
SELECT claim_id, -(sum(exp(t - mt) * s) / sum(exp(t - mt)) - any_value(ms) - ln(sum(exp(s - ms)))) AS listnet
FROM (SELECT *, max(s) OVER (PARTITION BY claim_id) AS ms, max(t) OVER (PARTITION BY claim_id) AS mt
      FROM ln_slots) GROUP BY claim_id"""


@register("listnet", with_views(
    "SELECT claim_id, round(listnet, 6) AS listnet FROM ln_claims",
    "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta", params=SS.PARAMS,
    ctes=SS.CHAIN[: SS.ORDER.index("aff") + 1] + [LISTNET_CTE, ("ln_claims", LISTNET_SQL)]))
def q_listnet(spark, sf_dir):
    s = scored(spark, sf_dir)["slots"]
    return listnet_per_claim(s, "claim_id", "affinity", "correlation") \
        .select("claim_id", r6("listnet").alias("listnet"))


def _joint_sql():
    return with_views("""
SELECT round(avg(l.listnet), 6) AS listnet,
       round(avg(greatest(g.logit, 0) - g.logit * s.label + ln(1 + exp(-abs(g.logit)))), 6) AS bce,
       round(0.01 * avg(l.listnet) + avg(greatest(g.logit, 0) - g.logit * s.label + ln(1 + exp(-abs(g.logit)))), 6)
         AS joint
FROM ln_claims l JOIN logits g USING (claim_id) JOIN f_token_sources s USING (claim_id)""",
                      "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta", params=SS.PARAMS,
                      ctes=SS.CHAIN + [LISTNET_CTE, ("ln_claims", LISTNET_SQL)])


@register("joint_loss", _joint_sql())
def q_joint(spark, sf_dir):
    r = scored(spark, sf_dir)
    ln = listnet_per_claim(r["slots"], "claim_id", "affinity", "correlation")
    j = ln.join(r["scores"], "claim_id")
    agg = j.agg(F.avg("listnet").alias("listnet"),
                F.avg(bce_terms(F.col("logit"), F.col("label").cast("double"))).alias("bce"))
    return agg.select(r6("listnet").alias("listnet"), r6("bce").alias("bce"),
                      r6(joint_loss(F.col("listnet"), F.col("bce"), 0.01)).alias("joint"))


REPORT_CTES = [
    ("ev", """SELECT s.label, CAST(1 / (1 + exp(-g.logit)) > 0.5 AS INTEGER) AS p, 1 / (1 + exp(-g.logit)) AS prob
              FROM logits g JOIN f_token_sources s USING (claim_id)"""),
    ("cells", """SELECT k, count_if(p = k AND label = k) AS tp, count_if(p = k AND label <> k) AS fp,
                        count_if(p <> k AND label = k) AS fn FROM ev, (SELECT unnest([0, 1]) AS k) GROUP BY k"""),
    ("prf", """SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM (
                 SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
                        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM cells)"""),
]
_CELLS = ", ".join(f"CAST(max({c}) FILTER (k = {k}) AS BIGINT) AS {c}_{k}" for c in ("tp", "fp", "fn") for k in (0, 1))
_RATES = ", ".join(f"round(max({c}) FILTER (k = {k}), 6) AS {m}_{k}" for m, c in (("precision", "pr"), ("recall", "re"), ("f1", "f1"))
                   for k in (0, 1))


@register("evaluate_split", with_views(f"""
SELECT *, (SELECT CAST(count(*) AS BIGINT) FROM ev) AS n, (SELECT round(avg(CAST(p = label AS DOUBLE)), 6) FROM ev) AS accuracy,
       (SELECT round(avg(CAST(p = label AS DOUBLE)), 6) FROM ev) AS f1_micro,
       (SELECT round(avg(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END), 6)
        FROM ev a, ev b WHERE a.label = 1 AND b.label = 0) AS auc
FROM (SELECT round(avg(f1), 6) AS f1_macro, {_CELLS}, {_RATES} FROM prf)""",
                                       "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta", params=SS.PARAMS,
                                       ctes=SS.CHAIN + REPORT_CTES))
def q_evaluate(spark, sf_dir):
    """Score a labelled split, threshold the probability, the whole report: counts,
    precision, recall and F1 per class, macro and micro F1, accuracy, AUC. The outcome
    histograms are ``logit_histogram``, the matrix is ``confusion_matrix``."""
    s = cut_lineage(scored(spark, sf_dir)["scores"].select(
        F.lit(0).alias("g"), "label", "prob", (F.col("prob") > 0.5).cast("int").alias("prediction")))  # counted and sorted
    rep = MX.prf_from_counts(MX.confusion_counts(s, ["g"])).withColumn("accuracy", (F.col("tp_0") + F.col("tp_1")) / F.col("n")) \
        .join(MX.roc_auc(s, ["g"], score="prob"), "g")
    cells = [f"{c}_{k}" for c in ("tp", "fp", "fn") for k in (0, 1)]
    rates = ["accuracy", "auc", "f1_macro", "f1_micro", *(f"{m}_{k}" for m in ("precision", "recall", "f1") for k in (0, 1))]
    return rep.select("n", *cells, *[r6(c).alias(c) for c in rates])


# ------------------------------------------------------------------ M2 / M5
def _mac_params():
    # Fixed fixture numbering of the mean-attention maps: matrices 17-20.
    return (_extra(17, H, H), _extra(18, 1, H)[0], _extra(19, H, H), _extra(20, 1, H)[0])


def _mac_sql():
    extra = " UNION ALL ".join([_extra_sql(17, H, H, "l1_w"), _extra_sql(18, 1, H, "l1_b"),
                                _extra_sql(19, H, H, "l2_w"), _extra_sql(20, 1, H, "l2_b")])
    return with_views(f"""
SELECT g.claim_id, g.evi_pos, 'claim' AS side, w.j, round(sum(c.v * w.v) + any_value(b.v), 6) AS v
FROM (SELECT DISTINCT claim_id, evi_pos FROM gbar) g JOIN cbar c USING (claim_id)
JOIN mac w ON w.name = 'l1_w' AND w.i = c.j JOIN mac b ON b.name = 'l1_b' AND b.j = w.j
GROUP BY g.claim_id, g.evi_pos, w.j
UNION ALL
SELECT g.claim_id, g.evi_pos, 'evidence', w.j, round(sum(g.v * w.v) + any_value(b.v), 6)
FROM gbar g JOIN mac w ON w.name = 'l2_w' AND w.i = g.j JOIN mac b ON b.name = 'l2_b' AND b.j = w.j
GROUP BY g.claim_id, g.evi_pos, w.j""", "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta",
                      params=SS.PARAMS, ctes=SS.CHAIN[: SS.ORDER.index("gbar") + 1] + [("mac", extra)])


@register("mean_attention", _mac_sql())
def q_mean_attention(spark, sf_dir):
    wc, bcl, we, be = _mac_params()
    h = AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir))
    m = AT.mean_attention(h, wc, bcl, we, be)
    both = m.select("claim_id", "evi_pos", F.explode(F.array(
        F.struct(F.lit("claim").alias("side"), F.col("c_hat").alias("v")),
        F.struct(F.lit("evidence").alias("side"), F.col("e_hat").alias("v")))).alias("s")).select("claim_id", "evi_pos", "s.*")
    return _long(both, ["claim_id", "evi_pos", "side"], "v", "j", "v")


def _add_sql():
    extra = " UNION ALL ".join([_extra_sql(21, H, 4, "a_w"), _extra_sql(22, 4, 1, "a_v")])
    return with_views("""
SELECT claim_id, j, round(sum(wt * v) / sum(wt), 6) AS v FROM (
  SELECT e.claim_id, e.evi_pos, e.j, e.v, exp(s.sc) AS wt FROM ehat e JOIN (
    SELECT claim_id, evi_pos, sum(tanh(zn) * av.v) AS sc FROM (
      SELECT claim_id, evi_pos, k, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6) AS zn
      FROM (SELECT e.claim_id, e.evi_pos, aw.j AS k, sum(e.v * aw.v) AS x
            FROM ehat e JOIN add_p aw ON aw.name = 'a_w' AND aw.i = e.j GROUP BY e.claim_id, e.evi_pos, aw.j)
      WINDOW w AS (PARTITION BY claim_id, evi_pos)) z
    JOIN add_p av ON av.name = 'a_v' AND av.i = z.k GROUP BY claim_id, evi_pos) s
  USING (claim_id, evi_pos))
GROUP BY claim_id, j""", "f_tokens", "f_tok_dims", "f_token_sources", "f_evidence_meta",
                      params=SS.PARAMS, ctes=SS.CHAIN[: SS.ORDER.index("ehat") + 1] + [("add_p", extra)])


@register("additive_attention", _add_sql())
def q_additive(spark, sf_dir):
    """M5 over the real evidence vectors of each claim (e_hat)."""
    co = AT.co_attention(AT.project_tokens(FX.tokens(spark, sf_dir), params(spark, sf_dir)),
                         params(spark, sf_dir))
    w, v = formula_matrix(21, H, 4), formula_matrix(22, 4, 1)
    pooled = AT.additive_attention(co["slots"].select("claim_id", "evi_pos", "e_hat"), "claim_id",
                                   "e_hat", w, v)
    return _long(pooled, ["claim_id"], "pooled")

